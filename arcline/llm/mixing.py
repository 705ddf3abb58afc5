"""Mixing sources to target weights.

The words of a source, document after document in a pseudorandom order, are cut into blocks of a fixed number
of words. A source gets as many slots as its target holds blocks; each slot draws its output shard, so the
counts of a source in the shards are multinomial. Slot k takes block ``permutation(k)``: a pseudorandom
permutation of the source's block numbers, a new one each time the source is gone through. Slots and blocks
meet by block number; a source is never sorted or gathered as a whole.

All arithmetic is on whole numbers and depends on the data alone, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, settled

#: A prime and two primitive roots of it, for pseudorandom numbers that any engine can repeat.
PRIME, ROOT, ROOT2 = 2147483647, 48271, 69621
WEIGHTS = (5, 2, 1)
#: No word is taken more often.
MOST = 3
ROUNDS = 12
#: Documents that one sorted piece of a source holds on average, and slots that one row unrolls.
PIECE, UNROLL = 2000, 4096
#: Slots that one task makes.
TASK = 1 << 16


@dataclass
class Mix:
    """docs: the given columns with src, size, first (word of the source), source_size, target, taken;
    blocks: (src, block, first, at, words), which words of which document a block holds;
    slots: (src, block, shard, place), the blocks of each output shard in the order of ``place``."""

    docs: DataFrame
    blocks: DataFrame
    slots: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mod(x: Column, n) -> Column:
    return F.pmod(x, n if isinstance(n, Column) else F.lit(n))


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source, source_size, weight, target) from (source, source_size); one row for each source.

    Shares go by weight until a source has ``MOST`` times its size; what it can't take goes to the others by
    weight. So target = least(MOST * size, level * weight), and the level is the largest that some set of the
    soonest full sources being full would give. Sources are numbered by code point, null last.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("src", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS)).cast("int") + 1).cast("long"))
    whole = W.partitionBy(F.lit(0))
    soonest = whole.orderBy(F.col("source_size") / F.col("weight"), "src")
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(soonest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(soonest.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - full) / rest)
    level = F.max("level").over(whole)
    return s.select("src", "source", "source_size", "weight", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target"))


def permuted(x: str, n: str, key: Column, df: DataFrame) -> DataFrame:
    """``df`` with column ``x`` (0 to n - 1) replaced by its image under the permutation of [0, n) that ``key`` names.

    Swap-or-not rounds (Hoang, Morris and Rogaway, 2012): a permutation for any n, without tables or search.
    """
    df = df.withColumn("_key", _mod(key, PRIME))
    for i in range(ROUNDS):
        k = _mod(_mod((F.col("_key") + 7919 * (i + 1)) * ROOT, PRIME), F.col(n))
        df = df.withColumn("_other", _mod(_mod((F.col("_key") + 7919 * (i + 1)) * ROOT, PRIME) - F.col(x), F.col(n)))
        df = df.withColumn("_high", F.greatest(x, "_other") + k * 31 + 977 * i + 1)
        df = df.withColumn("_bit", _mod(_mod(F.col("_high"), PRIME) * ROOT, PRIME))
        df = df.withColumn("_bit", _mod((F.col("_bit") + F.floor(F.col("_bit") / 4096)) * ROOT2, PRIME))
        df = df.withColumn(x, F.when(F.floor(F.col("_bit") / 1024) % 2 == 1, F.col("_other")).otherwise(F.col(x)))
    return df.drop("_key", "_other", "_high", "_bit")


def mix(docs: DataFrame, block_words: int = 64, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mixes all documents; see ``Mix`` for what comes back.

    Null and wordless texts have size 0 and are never taken. A null source is a source of its own. Repeated
    rows are rows of their own; documents of one id, null among them, are packed in order of size. Without
    words all targets are 0; an empty table gives empty results. Other columns are not looked at.
    """
    slim = settled(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    goal = settled(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))))
    goal = goal.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    goal = goal.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("name", F.col("source")).drop("source")
    rows = slim.join(goal.select("src", "name"), F.col("source").eqNullSafe(F.col("name"))).select("id", "size", "src")
    # first word of each document: sums by piece of the pseudorandom order, then within the piece
    width = max(1, PRIME // max(1, -(-slim.count() // PIECE)))
    at = _mod(_mod(F.coalesce(F.col("id").cast("long"), F.lit(-1)), PRIME) * ROOT, PRIME)
    rows = rows.withColumn("at", at).withColumn("piece", F.floor(F.col("at") / width))
    before = rows.groupBy("src", "piece").agg(F.sum("size").alias("n"))
    run = W.partitionBy("src").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("src", "piece", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    inside = W.partitionBy("src", "piece").orderBy("at", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["src", "piece"])
    rows = settled(rows.select("id", "src", "size", (F.col("before") + F.col("inside")).alias("first")))
    # blocks
    b, last = F.col("block") * block_words, F.col("first") + F.col("size")
    blocks = rows.filter("size > 0").select("src", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block_words), F.floor((last - 1) / block_words))).alias("block"))
    start = F.greatest(F.col("first"), b)
    blocks = blocks.select("src", "block", "first", (start - F.col("first")).alias("at"), (F.least(last, b + block_words) - start).alias("words"))
    # slots: number k of a source goes through its blocks again and again, each time in another order
    some = goal.filter("slots > 0").select("src", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / UNROLL))).alias("part"))
    slot_count = goal.agg(F.sum("slots")).first()[0] or 0
    some = some.repartition(max(1, -(-slot_count // TASK)), "src", "part")  # a number, as by size these few rows would stay in one task
    k0 = F.col("part") * UNROLL
    slots = some.select("src", "blocks", F.explode(F.sequence(k0, F.least(k0 + UNROLL, F.col("slots")) - 1)).alias("k"))
    slots = slots.withColumn("block", F.col("k") % F.col("blocks"))
    slots = permuted("block", "blocks", F.col("src") * 1103 + F.floor(F.col("k") / F.col("blocks")) * 104729 + 1, slots)
    draw = F.xxhash64("src", "k")
    # written, as a filter pushed through the rounds would repeat their expressions without end
    slots = settled(slots.select("src", "block", _mod(draw, shards).cast("int").alias("shard"), F.xxhash64(draw).alias("place")))
    # words taken
    uses = slots.groupBy("src", "block").agg(F.count("*").alias("uses"))
    taken = blocks.join(uses, ["src", "block"]).groupBy("src", "first").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # a document without words begins where the next one does and must not meet that one's sum
    taken = taken.select("src", "first", F.lit(True).alias("holds"), "taken")
    rows = rows.withColumn("holds", F.col("size") > 0).join(taken, ["src", "first", "holds"], "left").fillna(0, "taken")
    rows = rows.join(goal.select("src", "source_size", "target"), "src").select(F.col("id").alias(id_col), "src", "size", "first", "source_size", "target", "taken")
    return Mix(rows, blocks, slots)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).docs.select("doc_id", "size", "source_size", "target", "taken")


def _rounds() -> str:
    steps = ["p0 AS (SELECT src, nb, b AS x, ((src * 1103 + e * 104729 + 1) % 2147483647) AS key FROM slots)"]
    for i in range(ROUNDS):
        k = f"(((key + {7919 * (i + 1)}) * 48271) % 2147483647)"
        steps.append(f"q{i} AS (SELECT *, (({k} - x) % nb + nb) % nb AS y, {k} % nb AS k FROM p{i})")
        steps.append(f"r{i} AS (SELECT *, ((greatest(x, y) + k * 31 + {977 * i + 1}) % 2147483647 * 48271) % 2147483647 AS u FROM q{i})")
        steps.append(f"p{i + 1} AS (SELECT src, nb, key, CASE WHEN (((u + u // 4096) * 69621) % 2147483647) // 1024 % 2 = 1 THEN y ELSE x END AS x FROM r{i})")
    return ",\n".join(steps)


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s0),
s2 AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2 WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, src)),
s4 AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target, CAST(ceil(source_size / 64.0) AS BIGINT) AS nb FROM s3),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * nb / source_size) AS BIGINT) ELSE 0 END AS n FROM s4),
o AS (SELECT d.doc_id, goal.src, d.size, coalesce(sum(d.size) OVER (PARTITION BY goal.src
        ORDER BY ((coalesce(doc_id, -1) % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647, doc_id NULLS FIRST, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
slots AS (SELECT src, nb, k // nb AS e, k % nb AS b FROM (SELECT src, nb, unnest(range(n)) AS k FROM goal)),
{_rounds()},
uses AS (SELECT src, x AS block, count(*) AS uses FROM p{ROUNDS} GROUP BY src, x),
pieces AS (SELECT *, unnest(range(CAST(first // 64 AS BIGINT), CAST((first + size - 1) // 64 AS BIGINT) + 1)) AS block FROM o WHERE size > 0),
t AS (SELECT src, first, CAST(sum((least(first + size, block * 64 + 64) - greatest(first, block * 64)) * uses) AS BIGINT) AS taken
      FROM pieces JOIN uses USING (src, block) GROUP BY src, first)
SELECT o.doc_id, o.size, goal.source_size, goal.target, coalesce(t.taken, 0) AS taken
FROM o JOIN goal USING (src) LEFT JOIN t ON t.src = o.src AND t.first = o.first AND o.size > 0
"""
