"""SimHash near copies by multi-index hashing.

A fingerprint has one bit for each of 64 positions: set if more than half of the shingle hashes have it.
Two fingerprints link if few bits differ. To find links without comparing all pairs, a fingerprint is cut
into segments; if two differ in at most ``r`` bits, some segment differs in at most ``r // segments`` bits
(one less in the last segments). So each fingerprint looks up all values in a small Hamming ball around each
of its segments, and whole distances decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, components, settled, sorted_join

#: Shingles whose bits are counted at a time, so that a text of any length needs bounded memory.
CHUNK = 1 << 15
#: Members of a segment value up to which pairs are compared; larger ones take the exact way of ``ball_links``.
BUCKET = 256
#: Distinct fingerprints up to which three segments are narrow enough to be selective; two beyond.
WIDE = 1 << 25


def _bits(text: str | None, words_per_shingle: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    count, n = np.zeros(64, np.int64), len(words) - k + 1
    for c in range(0, n, CHUNK):
        top = min(c + CHUNK, n)
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[c:top], ends[c + k - 1:top + k - 1])], ">u8")
        count += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">i8")[0])


def fingerprint(text: Column, words_per_shingle: int = 4) -> Column:
    """64-bit SimHash of the whole text; zero if it is null or holds no word. Fewer words make one shingle."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_bits(t, words_per_shingle) for t in s], dtype="int64")

    return of(text)


def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of n segments that cover 64 bits."""
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _key(fp: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1))


def _around(ball: Column, seg: int, key: Column) -> Column:
    return F.transform(ball, lambda x: F.struct(F.lit(seg).alias("seg"), key.bitwiseXOR(x).alias("key")))


def links(prints: DataFrame, radius: int = 4, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) whose connected components are those of all links between the distinct values of ``fp``.

    Every link of two values whose segment value is shared by at most ``bucket`` others is a row. Values of
    fuller segment values are many close ones; for these ``ball_links`` gives as many links as keep the same
    components, in time that grows with the values and not with their pairs.
    """
    if segments is None:
        segments = 3 if prints.count() <= WIDE else 2
    own, probes = [], []
    s, rest = divmod(radius, segments)
    for i, (low, width) in enumerate(_segments(segments)):
        key = _key("fp", low, width)
        own.append(F.struct(F.lit(i).alias("seg"), key.alias("key")))
        reach = s if i <= rest else s - 1
        if reach >= 0:
            ball = F.lit(np.array(_ball(width, reach), np.int64))
            probes.append(_around(ball, i, key))
    table = prints.select(F.col("fp").alias("b"), F.explode(F.array(*own)).alias("k")).select("k.*", "b")
    looks = prints.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("k.*", "a")
    full = settled(table.groupBy("seg", "key").count().filter(F.col("count") > bucket).select("seg", "key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if full.isEmpty():
        return sorted_join(looks, table, ["seg", "key"]).filter((F.col("a") != F.col("b")) & near).select("a", "b").distinct()
    full = broadcast_if_small(full)
    plain = sorted_join(looks, table.join(full, ["seg", "key"], "left_anti"), ["seg", "key"]).filter((F.col("a") != F.col("b")) & near).select("a", "b")
    crowd = looks.join(full, ["seg", "key"], "left_semi").select(F.col("a").alias("fp"))
    crowd = crowd.unionByName(table.join(full, ["seg", "key"], "left_semi").select(F.col("b").alias("fp"))).distinct()
    return plain.unionByName(ball_links(settled(crowd), radius)).distinct()


def ball_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a, b) that keep the components of all links among ``fp``, about a star for each meeting point.

    Two values differ in at most ``radius`` bits just if the balls of half that radius around them meet, and
    all values that meet in a point are that close (to an odd radius, one side takes the larger half and
    distances decide). Each value joins the smallest one at each point of its ball.
    """
    half = radius // 2
    small = F.lit(np.array(_ball(64, half), np.uint64).view(np.int64))
    at = prints.select("fp", F.explode(F.transform(small, lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
    low = at.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("z", "b")
    stars = sorted_join(at, low, ["z"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    if radius % 2:
        wide = F.lit(np.array(_ball(64, half + 1), np.uint64).view(np.int64))
        far = prints.select(F.col("fp").alias("a"), F.explode(F.transform(wide, lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
        odd = sorted_join(far, low.unionByName(at.select("z", F.col("fp").alias("b"))).distinct(), ["z"])
        stars = stars.unionByName(odd.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
    return stars.distinct()


def groups_of(rows: DataFrame, radius: int = 4, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) of each distinct ``fp`` in ``rows`` (id, fp); root is the smallest fp of its component."""
    prints = settled(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(prints.select("fp"), radius, segments, bucket))
    named = sorted_join(prints, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4,
                segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) of each row; component_id is the smallest id that links lead to.

    Null or empty texts have fingerprint zero and are linked like any other. Rows with a null id keep it; their
    group takes the smallest id that is not null, or null. Repeated rows are repeated in the result, other
    columns are not looked at, and an empty table gives an empty result.
    """
    rows = settled(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words_per_shingle).alias("fp")))
    return rows.join(groups_of(rows, radius, segments, bucket), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest id stays, null ids last.

    Columns are those of ``docs``. Texts are written once with their fingerprints and moved once.
    """
    marked = settled(docs.withColumn("_fp", fingerprint(F.col(text_col), words_per_shingle)))
    rows = marked.select(F.col(id_col).alias("id"), F.col("_fp").alias("fp"))
    each = rows.groupBy("id", "fp").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "rows")).alias("k")
    keep = settled(each.join(groups_of(rows, radius), "fp").groupBy("root").agg(best).select("k.*"))

    def held(keys: DataFrame) -> DataFrame:
        return marked.join(keys.hint("shuffle_hash"), marked[id_col].eqNullSafe(keys["id"]) & (marked["_fp"] == keys["fp"]), "left_semi")

    out = held(keep)
    if not keep.filter("rows > 1").isEmpty():  # repeated rows: one of them stays
        out = held(keep.filter("rows = 1")).unionByName(held(keep.filter("rows > 1")).dropDuplicates([id_col, "_fp"]))
    return out.select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_copies(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
