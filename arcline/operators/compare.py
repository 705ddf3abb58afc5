"""Filters of a flight stretch side by side, and the rows they disown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import hypot
from .ordered import BLK, row_index, segments, windowed
from .smooth import sg_smooth

KEYS = ["session_id"]


def gram(u: Column, n: Column, degree: int) -> list[tuple[Column, Column]]:
    """(value, squared length) of the monic polynomials 0..degree that are orthogonal over n evenly spaced points centred on 0."""
    out = [(F.lit(1.0), n.cast("double"))]
    for k in range(degree):
        below = F.lit(0.0) if k == 0 else out[-2][0] * (k * k * (n * n - k * k) / (4.0 * (4 * k * k - 1)))
        value = u * out[-1][0] - below
        j = k + 1
        out.append((value, out[-1][1] * (j * j * (n * n - j * j) / (4.0 * (4 * j * j - 1)))))
    return out


def polynomial(rows: DataFrame, keys: Sequence[str], pos: str, n: str, degrees: dict[str, int], suffix: str = "_poly") -> DataFrame:
    """Least-squares polynomial of each column over the row positions 0..n-1 of a group, raw where the group is too short.

    The basis is orthogonal, so its coefficients are plain sums: one partial aggregate for all columns and degrees.
    """
    u, count = F.col(pos) - (F.col(n) - 1) / 2, F.col(n).cast("double")
    top = max(degrees.values())
    basis = gram(u, count, top)
    sums = [F.sum(basis[k][0] * F.col(c)).alias(f"_{c}{k}") for c, d in degrees.items() for k in range(d + 1)]
    t = rows.join(rows.groupBy(*keys).agg(*sums), list(keys))
    fit = {c + suffix: F.when(F.col(n) > d + 1, sum((F.try_divide(F.col(f"_{c}{k}"), basis[k][1]) * basis[k][0] for k in range(1, d + 1)), F.col(f"_{c}0") / count)).otherwise(F.col(c)) for c, d in degrees.items()}
    return t.withColumns(fit).drop(*[f"_{c}{k}" for c, d in degrees.items() for k in range(d + 1)])


def _median(values: Column, k: int) -> Column:
    """Median of up to k values; missing ones beyond the ends are zeros."""
    return F.element_at(F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), k - F.size(values)))), k // 2 + 1)


def compare_filters(points: DataFrame, gap: int = 3, cols: Sequence[str] = ("x", "y", "z"), degrees: dict[str, int] | None = None, residual: float = 0.5) -> DataFrame:
    """Per row and column: a median of five, a quadratic over seven rows and one polynomial over the whole stretch.

    Windows shrink to the largest odd size of a shorter stretch; the height is fitted by a parabola, the ground
    position by a line. ``outlier``: the row lies further than ``residual`` from its quadratic.
    """
    degrees = degrees or {c: 2 if c == "z" else 1 for c in cols}
    s = segments(points.select(*KEYS, "frame", *cols), KEYS, "frame", gap, "_stretch")
    part = [*KEYS, "_stretch"]
    s = s.join(s.groupBy(*part).agg(F.count("*").alias("_n")), part)
    s = row_index(s, part, "frame", "_i")

    def medians(t: DataFrame, w) -> DataFrame:
        near = Window.partitionBy(*part, BLK).orderBy("_i")
        pick = {}
        for c in cols:
            wide, slim = (_median(F.collect_list(c).over(near.rowsBetween(-h, h)), 2 * h + 1) for h in (2, 1))
            pick[f"{c}_median"] = F.when(F.col("_n") >= 5, wide).when(F.col("_n") >= 3, slim).otherwise(F.col(c))
        return t.withColumns(pick)

    s = windowed(s, part, "_i", medians, 2, 2)
    s = polynomial(s, part, "_i", "_n", degrees)
    for k in (7, 5):
        smooth = sg_smooth(points.select(*KEYS, "frame", *cols), k, 2, cols, KEYS, gap=gap)
        s = s.join(smooth.select(*KEYS, "frame", *[F.col(c).alias(f"_{c}{k}") for c in cols]), [*KEYS, "frame"])
    s = s.withColumns({f"{c}_sg": F.when(F.col("_n") >= 7, F.col(f"_{c}7")).when(F.col("_n") >= 5, F.col(f"_{c}5")).otherwise(F.col(c)) for c in cols})
    s = s.withColumn("outlier", hypot(*[F.col(c) - F.col(f"{c}_sg") for c in cols]) > residual)
    return s.select(*KEYS, "frame", *[f"{c}_{m}" for c in cols for m in ("median", "sg", "poly")], "outlier")
