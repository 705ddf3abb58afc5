"""Repeated runs of lines, found through a suffix array over line numbers; later copies are deleted.

Lines of all documents get a number (rank) by content. Prefix doubling ranks all suffixes by their first 1, 2,
4, ... lines: the rank of 2k lines comes from the pair of ranks of k lines here and k lines on, so that suffixes
share a rank just if their first lines agree, and ranks have the order of the suffixes. Suffixes that share d
lines are an interval of the suffix array with longest common prefixes of at least d. Two overlapping ranks that
cover d lines name that interval for any d, and its first member in the order of the documents is the copy that
stays.

A run is long enough with ``min_words`` words. A maximal repeated run is the union of its shortest windows that
are long enough, counted forwards from each line and backwards from each line, so those windows decide, and
doubling stops at the longest of them. A suffix whose first line occurs once in the corpus is settled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import broadcast_if_small, settled

#: Suffixes of one rank are counted in slices of this many bits of their second rank, so no group is sorted whole.
SLICE = 12


def _ranked(pairs: DataFrame) -> DataFrame:
    """(x, y, rank) from (x, y, n): x plus the number of rows of the same x with a smaller y."""
    p = pairs.withColumn("slice", F.shiftright("y", SLICE))
    upto = p.groupBy("x", "slice").agg(F.sum("n").alias("in"))
    before = F.coalesce(F.sum("in").over(W.partitionBy("x").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = upto.select("x", "slice", before.alias("before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("x", "slice").orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("inside", inside).join(upto, ["x", "slice"]).select("x", "y", (F.col("x") + F.col("before") + F.col("inside")).alias("rank"))


def _numbered(lines: DataFrame) -> DataFrame:
    """(a, b, rank) of each line content that occurs more than once: suffixes by their first line."""
    many = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").withColumn("x", F.shiftright("a", 52))
    start = many.groupBy("x").agg(F.sum("n").alias("in"))
    start = start.select("x", F.coalesce(F.sum("in").over(W.partitionBy(F.lit(0)).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("x").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return many.withColumn("inside", inside).join(start, "x").select("a", "b", (F.col("before") + F.col("inside")).alias("rank"))


def _doc(id_col: str) -> Column:
    """Identity and order of a document: null ids last; rows equal in id and text are one document."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(F.col("text")).alias("h"))


def _line_array() -> Column:
    return F.split(F.col("text"), "\n", -1)


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, pos, words) of each line to delete, from (doc, text) with one row for each doc; pos counts from 0."""
    each = docs.filter("text is not null").select("doc", F.posexplode(_line_array()).alias("pos", "line")).withColumn("line", F.trim(F.translate("line", "\t\x0b\x0c\r", "    ")))
    lines = settled(each.filter("line <> ''").select("doc", "pos", F.size(F.array_remove(F.split("line", " ", -1), "")).cast("long").alias("words"), F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b")))
    # lines that are followed by another repeated one stay together; blank lines don't part them
    by_doc = W.partitionBy("doc").orderBy("pos")
    rows = lines.withColumn("seq", F.row_number().over(by_doc)).join(_numbered(lines), ["a", "b"])
    rows = rows.withColumn("island", F.col("seq") - F.row_number().over(by_doc))
    island = W.partitionBy("doc", "island")
    rows = rows.withColumn("upto", F.sum("words").over(island.orderBy("pos"))).withColumn("total", F.sum("words").over(island)).filter(F.col("total") >= min_words)
    # lines of the shortest window of enough words that begins here, and that ends here
    begin = rows.withColumn("from", F.col("upto") - F.col("words"))
    ahead = F.count("*").over(island.orderBy("from").rangeBetween(0, min_words - 1))
    back = F.count("*").over(island.orderBy("upto").rangeBetween(-(min_words - 1), 0))
    rows = begin.withColumn("ahead", F.when(F.col("from") + min_words <= F.col("total"), ahead)).withColumn("back", F.when(F.col("upto") >= min_words, back))
    rows = settled(rows.select("doc", "island", "seq", "pos", "words", "ahead", "back", F.col("rank").alias("r0")))
    longest = rows.agg(F.max(F.greatest(F.coalesce("ahead", F.lit(0)), F.coalesce("back", F.lit(0))))).first()[0] or 0
    # prefix doubling: level k ranks the first 2^k lines, null where the island ends before
    level, order = 0, island.orderBy("seq")
    while 2 << level <= longest:
        two = rows.withColumn("x", F.col(f"r{level}")).withColumn("y", F.lead(f"r{level}", 1 << level).over(order))
        ranks = _ranked(two.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n")))
        level += 1
        rows = settled(two.join(ranks.withColumnRenamed("rank", f"r{level}"), ["x", "y"], "left").drop("x", "y"))
    # an interval of the suffix array: d lines and the ranks of the first and the last 2^k of them
    wide = rows.select("doc", "seq", F.array(*[f"r{k}" for k in range(level + 1)]).alias("r"))
    starts = rows.select("doc", F.col("seq").alias("s"), F.col("ahead").alias("d")).filter("d is not null")
    ends = rows.select("doc", (F.col("seq") - F.col("back") + 1).alias("s"), F.col("back").alias("d")).filter("d is not null")
    spans = starts.unionByName(ends).distinct().withColumn("k", F.floor(F.log2("d") + 1e-9).cast("int"))
    spans = spans.withColumn("t", F.col("s") + F.col("d") - F.expr("shiftleft(1, k)"))
    first = wide.select(F.col("doc"), F.col("seq").alias("s"), F.col("r").alias("p"))
    last = wide.select(F.col("doc"), F.col("seq").alias("t"), F.col("r").alias("q"))
    spans = spans.join(first, ["doc", "s"]).join(last, ["doc", "t"])
    spans = settled(spans.select("doc", "s", "d", F.element_at("p", F.col("k") + 1).alias("p"), F.element_at("q", F.col("k") + 1).alias("q")))
    kept = spans.groupBy("d", "p", "q").agg(F.min(F.struct("doc", "s")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    later = spans.join(kept, ["d", "p", "q"]).filter(F.struct("doc", "s") > F.col("kept"))
    gone = later.select("doc", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("d") - 1)).alias("seq")).distinct()
    return gone.join(rows.select("doc", "seq", "pos", "words"), ["doc", "seq"]).select("doc", "pos", "words")


def without_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines, removed_lines, removed_words, text) of each row, later copies of repeated line runs deleted.

    A line is deleted if a run of lines around it, of ``min_words`` words or more, occurs earlier as well: in a
    document of a smaller id (null ids last; ids alike: by a hash of the text), or further up in the same one.
    Lines are compared without white space around them; blank ones count in no run and stay. Rows equal in id
    and text are one document and get the same result. Null texts stay null with 0 lines; an empty text is one
    blank line. Other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = docs.withColumn("doc", _doc("id"))
    one = named.select("doc", "text")
    if not named.groupBy("doc").count().filter("count > 1").isEmpty():
        one = one.dropDuplicates(["doc"])
    gone = settled(later_copies(one, min_words))
    # neighbouring lines to delete as one run (first, last), a list of runs for each changed document
    step = F.col("pos") - F.row_number().over(W.partitionBy("doc").orderBy("pos"))
    runs = gone.withColumn("step", step).groupBy("doc", "step").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("lines"), F.sum("words").alias("words"))
    runs = runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("lines").alias("removed_lines"), F.sum("words").alias("removed_words"))
    out = named.join(broadcast_if_small(settled(runs)), "doc", "left").withColumn("parts", _line_array())
    # what stays lies before the first run, between two, and after the last; parts is used twice so that it is made once
    n, last = F.size("parts"), F.size("runs")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["last"] + 1)
    end = lambda i: F.when(i == last, n).otherwise(F.get("runs", i)["first"])
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("parts", begin(i) + 1, F.greatest(F.lit(0), end(i) - begin(i))))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("lines"),
                      F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"), text.alias("text"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT doc_id, pos, raw, trim(translate(raw, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS line FROM l),
w AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM n WHERE line <> ''),
c AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto, CAST(sum(words) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM w),
e AS (SELECT *, upto - words AS start FROM c),
m AS (SELECT *, CASE WHEN start + 50 <= total THEN count(*) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS ahead,
             CASE WHEN upto >= 50 THEN count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) END AS back FROM e),
s AS (SELECT doc_id, seq AS s, ahead AS d FROM m WHERE ahead IS NOT NULL UNION SELECT doc_id, seq - back + 1, back FROM m WHERE back IS NOT NULL),
a AS (SELECT doc_id, list(line ORDER BY seq) AS ls FROM w GROUP BY doc_id),
k AS (SELECT s.doc_id, s, d, array_to_string(ls[s:s + d - 1], chr(10)) AS t FROM s JOIN a USING (doc_id)),
f AS (SELECT *, first_value(struct_pack(doc_id := doc_id, s := s)) OVER (PARTITION BY t ORDER BY doc_id, s) AS kept FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + d)) AS seq FROM f WHERE (doc_id, s) <> (kept.doc_id, kept.s)),
r AS (SELECT doc_id, count(*) AS removed_lines, CAST(sum(words) AS BIGINT) AS removed_words, list(pos) AS gone FROM g JOIN w USING (doc_id, seq) GROUP BY doc_id),
b AS (SELECT n.doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT list_contains(gone, pos)) AS built FROM n JOIN r USING (doc_id) GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words,
  CASE WHEN r.doc_id IS NULL THEN text ELSE coalesce(built, '') END AS text
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)
"""
