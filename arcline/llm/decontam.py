"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

A document contains an item if it has a share of at least ``least`` of the item's distinct shingles. Items are
partitioned by size in powers of two. In a partition of up to u shingles at most floor((1 - least) * u) may be
missing, so one more of an item's smallest hash values than that can't all be missing: these are its sketch,
and a document that has none of them is no candidate. Nothing is estimated, so no match is lost, however long
the document around a short item. Hash values are taken in the order (items that share the shingle, hash), so
that phrases common to many items don't make candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import broadcast_if_small, settled

#: Between words: all but letters and digits. Fixed in the SQL twin as well.
BREAKS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; null and wordless texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def _each(w: Column, k: int, of) -> Column:
    """``of(shingle as an array)`` for each shingle of ``k`` words; fewer words make one shingle."""
    n = F.size(w)
    starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(w, i, k)))


def shingle_texts(w: Column, k: int) -> Column:
    return _each(w, k, lambda s: F.array_join(s, " "))


def shingle_hashes(w: Column, k: int) -> Column:
    return _each(w, k, lambda s: F.xxhash64(s))


def sketches(items: DataFrame, least: float) -> DataFrame:
    """(item_id, size, hash): the sketch of each item; ``items`` has each distinct shingle once (item_id, shingle)."""
    each = items.select("item_id", "shingle_hash")
    size = each.groupBy("item_id").agg(F.count("*").alias("size"))
    top = F.pow(F.lit(2.0), F.ceil(F.log2("size")))  # the largest size of its partition
    # the small amount keeps (1 - 0.8) * 5 from falling below 1
    size = size.select(F.col("item_id").alias("i"), "size", (F.floor((1 - least) * top + 1e-9) + 1).alias("keep"))
    shared = each.groupBy("shingle_hash").agg(F.count("*").alias("items"))
    order = W.partitionBy("item_id").orderBy("items", "shingle_hash")
    ranked = each.join(shared, "shingle_hash").withColumn("place", F.row_number().over(order))
    return ranked.join(size, F.col("item_id").eqNullSafe(F.col("i"))).filter(F.col("place") <= F.col("keep")).select("item_id", "size", "shingle_hash")


def contaminated(docs: DataFrame, bench: DataFrame, least: float = 0.8, shingle_words: int = 5,
                 doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, size, containment) of each document and item with a containment of at least ``least``.

    Words are runs of letters and digits in lower case; shingles are distinct. A text of fewer words is one
    shingle, so a very short item is found just in a document of the same words. Null and wordless texts match
    nothing. Rows that share an id, null among them, are one document (or item) with the shingles of all its
    rows. Empty tables give no rows; other columns are not looked at.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter("text is not null")
    bench = bench.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words"))
    both = F.arrays_zip(shingle_texts(F.col("words"), shingle_words).alias("shingle"), shingle_hashes(F.col("words"), shingle_words).alias("shingle_hash"))
    items = settled(bench.select("item_id", F.explode(both).alias("s")).select("item_id", "s.*").distinct())
    sketch = settled(sketches(items, least))
    # words are a column of their own: inside the expressions over each position they would be made again and again
    seen = docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", F.explode(shingle_hashes(F.col("words"), shingle_words)).alias("shingle_hash"))
    pairs = settled(seen.join(broadcast_if_small(sketch.select("shingle_hash", "item_id")), "shingle_hash").select("doc_id", "item_id").distinct())
    # exact: all shingles of the candidates, as text
    asked = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    mine = docs.join(broadcast_if_small(asked.select("d").distinct()), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    mine = mine.select("doc_id", words(F.col("text")).alias("words"))
    mine = mine.select("doc_id", F.explode(F.array_distinct(shingle_texts(F.col("words"), shingle_words))).alias("shingle"))
    hits = mine.join(broadcast_if_small(items.select("item_id", "shingle")), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    hits = hits.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    size = sketch.select(F.col("item_id").alias("i"), "size").distinct()
    out = hits.join(size, F.col("item_id").eqNullSafe(F.col("i"))).withColumn("containment", F.col("shared") / F.col("size"))
    return out.filter(F.col("containment") >= least).select("doc_id", "item_id", "shared", "size", "containment")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS size FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size, CAST(count(*) AS DOUBLE) / any_value(size) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(size)
"""
