"""Exact order statistics per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], rule: str = "linear", step: float = 0.01) -> DataFrame:
    """Exact quantiles: count in bins of width ``step``, then rank only the bins that hold them.

    ``linear`` interpolates between neighbours; ``index`` takes element int(n * q) of the sorted
    values (at most the last one).
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.floor(F.col(value) / step).cast("long").alias("_bin"))
    bins = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumns({"_to": upto, "_n": F.sum("_c").over(w)}).withColumn("_from", F.col("_to") - F.col("_c"))

    def ranks(q: float) -> list[Column]:
        if rule == "index":
            i = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1).cast("long")
            return [i, i]
        pos = (F.col("_n") - 1) * q
        return [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]

    want = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), k.alias("rank"),
                 ((F.col("_n") - 1) * q - k if rule == "linear" and end == 0 else F.lit(0.0)).cast("double").alias("frac"))
        for name, q in wanted.items() for end, k in enumerate(ranks(q))])
    held = bins.select(*by, "_bin", "_from", F.explode(F.filter(want, lambda s: (s["rank"] >= F.col("_from")) & (s["rank"] < F.col("_to")))).alias("_t"))
    held = held.select(*by, "_bin", "_from", "_t.*")
    inside = rows.join(held.select(*by, "_bin", "_from").distinct(), [*by, "_bin"]).groupBy(*by, "_bin", "_from", "_v").agg(F.count("*").alias("_c"))
    top = F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from")
    inside = inside.withColumn("_hi", top).withColumn("_lo", F.col("_hi") - F.col("_c")).drop("_from", "_c")
    hit = held.join(inside, [*by, "_bin"]).where((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    aggs = []
    for name in wanted:
        at = lambda e, c: F.max(F.when((F.col("name") == name) & (F.col("end") == e), F.col(c)))  # noqa: B023, E731
        lo, hi, frac = at(0, "_v"), at(1, "_v"), at(0, "frac")
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return hit.groupBy(*by).agg(*aggs)


def with_quantiles(summary: DataFrame, df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], **kw) -> DataFrame:
    return summary.join(quantiles(df, by, value, wanted, **kw), list(by), "left")


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
