"""Shards of near equal bytes as leaves of a k-d tree over document metadata.

Coordinates are whole numbers in [0, 2^20) for language, source and length. A node that holds several shards'
bytes is split along its widest coordinate at the weighted median (or at the share of bytes that its left
half of the shards should get). The median of all nodes of a level is found at once: rows are summed by bin of
the split key, the bin that holds the median is cut into finer bins, and so on until it is exact to a row.
Ties in a coordinate are settled by a pseudorandom number of the id, so a hot source or language splits too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settled

PRIME, ROOT = 2147483647, 48271  # fixed values: a prime and a primitive root of it
COORD, TIE = 20, 31  # bits of a coordinate and of the tie breaker below it
STEP = 17  # bits of the key that one refinement settles; so a node has at most 2^17 bins
#: Rows of one sorted piece of a shard, on average, when slots are counted.
PIECE = 20_000


def _prefix_number(c: str) -> Column:
    """The first six bytes as a number: keeps the order of text, without a table of all values. Null is 0."""
    head = F.rpad(F.hex(F.substring(F.col(c).cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long") + 1, F.lit(0))


def _scaled(c: str, low: str, high: str) -> Column:
    top = (1 << COORD) - 1
    return F.when(F.col(high) > F.col(low), F.floor((F.col(c) - F.col(low)) / (F.col(high) - F.col(low)) * top)).otherwise(0).cast("long")


def _split_points(rows: DataFrame) -> DataFrame:
    """(node, cut): rows of a node with key < cut go left; their bytes are as near to ``left`` as keys allow.

    ``rows`` has node, key, size and the node's left (bytes). The state of each node, the lower end of a bin
    and the bytes below it, is a row of a table; each step meets just the rows of the one bin that is open, by
    its number, and sums them by finer bins.
    """
    bits, state = COORD + TIE, None
    while bits > 0:
        rest = bits - min(STEP, bits)
        if state is None:
            bins = rows.withColumn("low", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
        else:
            bins = rows.select("node", "key", "size", F.shiftright("key", bits).alias("open")).join(state.withColumn("open", F.shiftright("low", bits)), ["node", "open"])
        bins = bins.withColumn("bin", F.shiftright(F.col("key") - F.col("low"), rest)).groupBy("node", "bin").agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first("low").alias("low"), F.first("below").alias("below"))
        bins = bins.withColumn("upto", F.sum("n").over(W.partitionBy("node").orderBy("bin")) + F.col("below"))
        # the first bin that passes the goal holds the cut
        first = bins.filter(F.col("upto") > F.col("left")).groupBy("node").agg(F.min_by(F.struct("bin", "n", "upto", "left", "low"), "bin").alias("b"))
        state = settled(first.select("node", F.col("b.left").alias("left"), (F.col("b.low") + F.shiftleft(F.col("b.bin"), rest)).alias("low"), (F.col("b.upto") - F.col("b.n")).alias("below"), F.col("b.n").alias("last")))
        bits = rest
    # the row at the median goes to the side that it leaves nearer to its goal
    nearer = F.col("below") + F.col("last") - F.col("left") < F.col("left") - F.col("below")
    return state.select("node", (F.col("low") + nearer.cast("long")).alias("cut"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row: shards from 0, slots from 0 without gaps in each shard.

    Give the number of ``shards``, or ``target_bytes`` for as many as keep each at or under it but for one row.
    Size is the UTF-8 bytes of the text plus 1 (null: 1); a null text has the checksum of no bytes, 0. Null
    ids, languages and sources are values of their own. Rows equal in id and coordinates have one key and stay
    together, so ids that repeat without end make shards uneven. Empty tables give no rows.
    """
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                       _prefix_number(lang_col).alias("c0"), _prefix_number(source_col).alias("c1"))
    slim = slim.withColumn("c2", F.floor(F.log2("size") * 1000).cast("long"))
    slim = slim.withColumn("tie", F.pmod(F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(-1)), F.lit(PRIME)) * ROOT, F.lit(PRIME)))
    slim = settled(slim)
    ends = slim.agg(F.sum("size").alias("total"), F.count("*").alias("n"), *[f(f"c{i}").alias(f"{k}{i}") for i in range(3) for k, f in (("low", F.min), ("high", F.max))])
    total, count = ends.select("total", "n").first()
    leaves = shards or max(1, -(-(total or 0) // target_bytes))
    box = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in ends.first().asDict().items()])
    rows = slim.withColumn("box", box).select("id", "size", "text_crc32", "tie", *[_scaled(f"c{i}", f"box.low{i}", f"box.high{i}").alias(f"c{i}") for i in range(3)])
    rows = rows.withColumn("node", F.lit(0)).withColumn("parts", F.lit(leaves))  # node: its first shard; parts: how many shards it holds
    while leaves > 1:
        # widest coordinate and bytes of each node
        nodes = rows.filter("parts > 1").groupBy("node", "parts").agg(F.sum("size").alias("bytes"), *[(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(3)])
        axis = F.when((F.col("w0") >= F.col("w1")) & (F.col("w0") >= F.col("w2")), 0).when(F.col("w1") >= F.col("w2"), 1).otherwise(2)
        half = F.floor(F.col("parts") / 2)
        nodes = settled(nodes.select("node", axis.alias("axis"), F.floor(F.col("bytes") * half / F.col("parts")).alias("left"), half.cast("int").alias("half")))
        keyed = rows.join(nodes, "node", "left")
        key = F.element_at(F.array("c0", "c1", "c2"), F.col("axis") + 1) * (1 << TIE) + F.col("tie")
        keyed = keyed.withColumn("key", key)
        cuts = _split_points(keyed.filter("axis is not null").select("node", "key", "size", "left"))
        keyed = keyed.join(cuts, "node", "left")
        right = F.coalesce(F.col("key") >= F.col("cut"), F.lit(False))
        rows = settled(keyed.select("id", "size", "text_crc32", "tie", "c0", "c1", "c2",
                                    F.when(right, F.col("node") + F.col("half")).otherwise(F.col("node")).alias("node"),
                                    F.when(F.col("half").isNull(), F.col("parts")).when(right, F.col("parts") - F.col("half")).otherwise(F.col("half")).alias("parts")))
        leaves = -(-leaves // 2)
    # slots: counts by piece of the pseudorandom order, then within the piece
    width = max(1, PRIME // max(1, -(-count // PIECE)))
    rows = rows.withColumn("piece", F.floor(F.col("tie") / width))
    before = rows.groupBy("node", "piece").agg(F.count("*").alias("n"))
    run = W.partitionBy("node").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("node", "piece", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("node", "piece").orderBy("tie", "id", "size", "text_crc32"))
    rows = rows.withColumn("inside", inside).join(before, ["node", "piece"])
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("node").alias("shard"), (F.col("before") + F.col("inside") - 1).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
