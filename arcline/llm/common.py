"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline.session import shared_folder

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a lookup table up to which it is broadcast (16 to 150 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast: Spark sizes a table by its columns, so an exploded one looks as small as its source."""
    return left.join(right.hint("merge"), on, how)


#: Paths that ``settled`` wrote, by open ``alone``.
_written: list[list[str]] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: short lineage, and nothing is computed twice.

    A lost executor costs at most the tasks of the current step; the files are read by all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The settled result of ``make``; the tables that were settled on the way to it are deleted."""
    _written.append([])
    try:
        out = settled(make())
    finally:
        paths = _written.pop()
    spark = out.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths[:-1]:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if _written:
        _written[-1].append(paths[-1])
    return out


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014), each an aggregate and a join, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. A node with very many
    neighbours is a skewed join key, which adaptive execution splits; its neighbours are never gathered.
    """
    links = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        # large star: larger neighbours point to the smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours point to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = settled(small.filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = tuple(now)
