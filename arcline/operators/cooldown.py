"""Suppression in order, without going through the rows one by one.

What a sequential rule keeps next depends only on the row it stands on, so every candidate gets a link to the row
it would go on to, found in a window of bounded reach. A candidate far enough from the one before it is reached in
any case; the others are reached if a chain of links leads to them. Links are joined with themselves, so they
double in length each round and the number of rounds grows with the logarithm of the longest chain, however many
blocks it spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import windowed


def reached(links: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, order) of the rows a chain leads to. ``links``: keys, order, ``_root`` (reached anyway), ``_next`` (null: none)."""
    keys = list(keys)
    links = cut_lineage(links.select(*keys, order, "_root", "_next"))
    hit = links.where("_root").select(*keys, order)
    jump = links.where("_next is not null").select(*keys, F.col(order).alias("_a"), F.col("_next").alias("_b"))
    while True:
        step = hit.join(jump, [*[hit[k] == jump[k] for k in keys], hit[order] == jump["_a"]], "left_semi")
        new = step.join(jump.withColumnRenamed("_a", order), [*keys, order]).select(*keys, F.col("_b").alias(order))
        new = cut_lineage(new.join(hit, [*keys, order], "left_anti").distinct())
        if new.isEmpty():
            return hit
        hit = cut_lineage(hit.unionByName(new))
        ahead = jump.select(*keys, F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        jump = cut_lineage(jump.join(ahead, [*keys, "_b"]).select(*keys, "_a", F.col("_c").alias("_b")))


def _links(cand: DataFrame, keys: Sequence[str], order: str, gap: int, better: Column | None = None) -> DataFrame:
    """``cand`` with ``_root``, ``_next`` and ``_kept`` (no better row takes its place)."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag(order).over(w)
        far = F.min(order).over(w.rangeBetween(gap, 2 * gap - 1))
        t = t.withColumns({"_root": prev.isNull() | (F.col(order) - prev >= gap), "_far": far})
        if better is None:
            return t.withColumns({"_next": F.col("_far"), "_kept": F.lit(True)}).drop("_far")
        t = t.withColumn("_score", better)
        near = F.collect_list(F.struct(F.col(order).alias("o"), F.col("_score").alias("s"))).over(w.rangeBetween(1, max(gap - 1, 1)))
        t = t.withColumn("_near", near if gap > 1 else F.array().cast("array<struct<o:long,s:double>>"))
        wins = F.get(F.filter("_near", lambda r: r["s"] > F.col("_score")), F.lit(0))["o"]
        return t.withColumn("_win", wins).withColumns({"_next": F.coalesce("_win", "_far"), "_kept": F.col("_win").isNull()}).drop("_far", "_near", "_score", "_win")

    return windowed(cand.withColumn(order, F.col(order).cast("long")), keys, order, build, gap, 2 * gap)


def first_wins(cand: DataFrame, keys: Sequence[str], gap: int, order: str = "frame") -> DataFrame:
    """Keep a row only when the last kept one is at least ``gap`` away; rows of one ``order`` stay or go together."""
    if gap <= 0:
        return cand
    at = cand.select(*keys, F.col(order).cast("long").alias(order)).distinct()
    return cand.join(reached(_links(at, keys, order, gap), keys, order), [*keys, order], "left_semi")


def last_better(cand: DataFrame, keys: Sequence[str], gap: int, score: Column, order: str = "frame") -> DataFrame:
    """A row nearer than ``gap`` to the last kept one replaces it with a higher score only, and is measured from then on."""
    if gap <= 0:
        return cand
    links = cut_lineage(_links(cand, keys, order, gap, score))
    return links.join(reached(links, keys, order), [*keys, order], "left_semi").where("_kept").drop("_root", "_next", "_kept")


def lowest_in_group(cand: DataFrame, keys: Sequence[str], span: int, value: str, order: str = "frame") -> DataFrame:
    """Groups begin at a row and take all rows within ``span`` of it; the first lowest row of each stays."""
    starts = first_wins(cand.select(*keys, order), keys, span + 1, order).distinct().withColumn("_start", F.lit(True))
    t = cand.join(starts, [*keys, order], "left")
    t = windowed(t, keys, order, lambda t, w: t.withColumn("_group", F.max(F.when(F.col("_start"), F.col(order))).over(w.rangeBetween(-span, 0))), span, 0)
    row = F.struct(*[F.col(c) for c in cand.columns if c not in keys])
    low = t.groupBy(*keys, "_group").agg(F.min_by(row, F.struct(value, order)).alias("_r"))
    return low.select(*keys, "_r.*")
