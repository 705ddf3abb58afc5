"""Flight arcs: weighted parabola fits from moment sums, robust selection, strokes, landings.

A fit is a handful of sums per group, so it is a partial aggregate whatever the group size; the
ordinate is centred per group before the sums are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..court import COURT, GRAVITY
from ..functions.geometry import hypot
from ..session import cut_lineage
from .ordered import neighbour, row_index, running
from .stats import ratio

COEF = ["ax", "bx", "az", "bz", "cz"]
#: Rows of a group that robust fits are scored on at a time.
CHUNK = 1024


def _solve(s: list[Column], b: list[Column]) -> list[Column]:
    """Coefficients c0 + c1 u + c2 u^2 of the weighted normal equations."""
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    # nearly singular systems (fewer than three distinct ordinates) give null
    ok = F.abs(det) > 1e-9 * F.abs(s[0] * s[2] * s[4])
    n0 = b[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (b[1] * s[4] - s[3] * b[2]) + s[2] * (b[1] * s[3] - s[2] * b[2])
    n1 = s[0] * (b[1] * s[4] - b[2] * s[3]) - b[0] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * b[2] - b[1] * s[2])
    n2 = s[0] * (s[2] * b[2] - s[3] * b[1]) - s[1] * (s[1] * b[2] - s[2] * b[1]) + b[0] * (s[1] * s[3] - s[2] * s[2])
    return [F.when(ok, n / det) for n in (n0, n1, n2)]


def parabola_fits(points: DataFrame, by: Sequence[str], min_rows: int = 3) -> DataFrame:
    """X(Y) linear and Z(Y) quadratic per group, weights 1 / ray distance; speed from gravity.

    Columns: coefficients in the original Y, ``n``, ``y_min``, ``y_max``, ``y_first``, ``speed_ms``.
    """
    by = list(by)
    centre = points.groupBy(*by).agg(F.avg("y").alias("_my"))
    u = F.col("y") - F.col("_my")
    w = 1 / F.greatest(F.col("ray_dist"), F.lit(0.01))
    t = points.join(centre, by).withColumns({"_u": u, "_w": w})
    pw = lambda k: F.pow(F.col("_u"), F.lit(float(k))) * F.col("_w")
    aggs = [F.sum(pw(k)).alias(f"_s{k}") for k in range(5)] + [F.sum(pw(k) * F.col("z")).alias(f"_z{k}") for k in range(3)]
    aggs += [F.sum(pw(k) * F.col("x")).alias(f"_x{k}") for k in range(2)]
    s = t.groupBy(*by, "_my").agg(*aggs, F.count("*").alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min_by("y", "frame").alias("y_first"))
    m, z, x = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_z{k}") for k in range(3)], [F.col(f"_x{k}") for k in range(2)]
    c0, c1, c2 = _solve(m, z)
    det = m[0] * m[2] - m[1] * m[1]
    s = s.where(F.col("n") >= min_rows).withColumns({
        "_c0": c0, "_c1": c1, "az": c2, "ax": F.try_divide(m[0] * x[1] - m[1] * x[0], det), "_x": F.try_divide(m[2] * x[0] - m[1] * x[1], det)})
    my = F.col("_my")
    s = s.withColumns({
        "bz": F.col("_c1") - 2 * F.col("az") * my, "cz": F.col("_c0") - F.col("_c1") * my + F.col("az") * my * my, "bx": F.col("_x") - F.col("ax") * my})
    s = s.withColumn("speed_ms", speed_at(F.col("y_first")))
    return s.select(*by, *COEF, "n", "y_min", "y_max", "y_first", "speed_ms")


def forward_speed() -> Column:
    vy = F.when(F.col("az") < -1e-6, F.sqrt(GRAVITY / (-2 * F.col("az")))).otherwise(25.0)
    return F.least(F.greatest(vy, F.lit(1.0)), F.lit(80.0))


def speed_at(y: Column) -> Column:
    dz = 2 * F.col("az") * y + F.col("bz")
    return forward_speed() * F.sqrt(1 + F.col("ax") * F.col("ax") + dz * dz)


def fit_error(x: Column, y: Column, z: Column) -> Column:
    return hypot(F.col("ax") * y + F.col("bx") - x, F.col("az") * y * y + F.col("bz") * y + F.col("cz") - z)


def residuals(points: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.join(fits.select(*by, *COEF), list(by)).withColumn("error", fit_error(F.col("x"), F.col("y"), F.col("z")))


def fit_quality(points: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    e = residuals(points, fits, by).groupBy(*by).agg(F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))
    return fits.join(e, list(by))


def gravity_fits(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Start position and velocity with fixed gravity: linear least squares in time per axis."""
    by = list(by)
    t0 = points.groupBy(*by).agg(F.min("t").alias("_t0"))
    dt = F.col("t") - F.col("_t0")
    p = points.join(t0, by).withColumns({"_dt": dt, "_zg": F.col("z") + 0.5 * GRAVITY * dt * dt})
    s = p.groupBy(*by).agg(F.count("*").alias("n"), *[e for c, a in (("x", "x"), ("y", "y"), ("_zg", "z")) for e in (
        F.regr_slope(c, "_dt").alias(f"v{a}"), F.regr_intercept(c, "_dt").alias(f"p{a}"))])
    return s.where("n >= 3").withColumn("speed_ms", hypot(F.col("vx"), F.col("vy"), F.col("vz")))


def ransac_fits(points: DataFrame, by: Sequence[str], trials: int = 300, threshold: float = 0.5, min_ratio: float = 0.4, max_kmh: float = 350.0) -> DataFrame:
    """Inlier rows of the best of many four-row fits, then refitted; groups without enough
    agreement keep all rows.

    A trial's rows sit at four distinct hashed positions of the group, so drawing needs only the
    group's row count. Rows travel as chunks of ``CHUNK`` positions: a chunk gives the rows drawn
    from it, and one array row of fits per group scores it. No table of rows by trials is made.
    """
    by = list(by)
    cols = [*by, "frame", "x", "y", "z", "ray_dist"]
    idx = cut_lineage(row_index(points.select(*cols), by, "frame"))
    n = idx.groupBy(*by).agg(F.count("*").alias("_n"))
    chunk = F.floor(F.col("idx") / CHUNK)
    rows = F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z", "ray_dist")))
    chunks = cut_lineage(idx.groupBy(*by, chunk.alias("_c")).agg(rows.alias("_p")).join(n.where("_n >= 4"), by))
    h = lambda t, k: F.pmod(F.xxhash64(t, F.lit(k), *by), F.col("_n"))
    picks = lambda t: F.slice(F.array_distinct(F.array(*[h(t, k) for k in range(12)])), 1, 4)
    row_at = lambda i: F.element_at("_p", (i - F.col("_c") * CHUNK + 1).cast("int"))
    own = lambda t: F.transform(F.filter(picks(t), lambda i: F.floor(i / CHUNK) == F.col("_c")), lambda i: F.struct(t.alias("trial"), row_at(i).alias("p")))
    drawn = chunks.select(*by, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), own)).alias("_d"))
    # at most four rows a trial meet here, however long the group is
    drawn = drawn.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("_d"))).alias("_d"))
    fits = drawn.select(*by, _trial_fits()("_d.trial", *[f"_d.p.{c}" for c in ("x", "y", "z", "ray_dist")]).alias("_f"))
    sound = F.filter("_f", lambda f: (f["az"] < 0) & (f["speed_ms"] * 3.6 <= max_kmh))
    fits = cut_lineage(fits.select(*by, sound.alias("_f")).where(F.size("_f") > 0))
    hits = _trial_hits(threshold)(*[F.col(f"_p.{c}") for c in "xyz"], *[F.col(f"_f.{c}") for c in COEF])
    score = chunks.join(fits, by).select(*by, F.posexplode(hits).alias("_at", "hits")).groupBy(*by, "_at").agg(F.sum("hits").alias("hits"))
    best = score.groupBy(*by).agg(F.max(F.struct("hits", (-F.col("_at")).alias("first"))).alias("b")).select(*by, F.col("b.hits").alias("hits"), (-F.col("b.first")).alias("_at"))
    best = best.join(n, by).where(F.col("hits") >= F.greatest(F.lit(3), F.floor(F.col("_n") * min_ratio)))
    best = cut_lineage(best.join(fits, by).withColumn("_b", F.element_at("_f", F.col("_at") + 1)).select(*by, "hits", *[F.col(f"_b.{c}") for c in COEF]))
    first = cut_lineage(residuals(idx, best, by).where(F.col("error") < threshold))
    again = cut_lineage(residuals(idx, parabola_fits(first, by), by).where(F.col("error") < threshold))
    more = again.groupBy(*by).agg(F.count("*").alias("_m")).join(best.select(*by, "hits"), by).where(F.col("_m") > F.col("hits")).select(*by)
    robust = again.join(more, by, "left_semi").select(*cols).unionByName(first.join(more, by, "left_anti").select(*cols))
    rest = idx.join(best.select(*by), by, "left_anti").select(*cols)
    return robust.unionByName(rest)


def _trial_fits():
    """``parabola_fits`` of each trial's four rows, which follow each other in row order; unsound ones are left out."""

    def fits(t, *xyzr) -> list[dict]:
        kinds, at, count = np.unique(np.asarray(t), return_index=True, return_counts=True)
        kinds, at = kinds[count == 4], at[count == 4]
        x, y, z, ray = (np.asarray(c, float)[at[:, None] + np.arange(4)] for c in xyzr)
        my, w = y.mean(axis=1), 1 / np.maximum(ray, 0.01)
        u = y - my[:, None]
        s = [(u ** k * w).sum(axis=1) for k in range(5)]
        bz = [(u ** k * w * z).sum(axis=1) for k in range(3)]
        bx = [(u ** k * w * x).sum(axis=1) for k in range(2)]
        with np.errstate(all="ignore"):
            det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
            c0 = (bz[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (bz[1] * s[4] - s[3] * bz[2]) + s[2] * (bz[1] * s[3] - s[2] * bz[2])) / det
            c1 = (s[0] * (bz[1] * s[4] - s[3] * bz[2]) - bz[0] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * bz[2] - bz[1] * s[2])) / det
            az = (s[0] * (s[2] * bz[2] - s[3] * bz[1]) - s[1] * (s[1] * bz[2] - s[2] * bz[1]) + bz[0] * (s[1] * s[3] - s[2] * s[2])) / det
            line = s[0] * s[2] - s[1] * s[1]
            ax, mid = (s[0] * bx[1] - s[1] * bx[0]) / line, (s[2] * bx[0] - s[1] * bx[1]) / line
            b, c = c1 - 2 * az * my, c0 - c1 * my + az * my * my
            vy = np.clip(np.where(az < -1e-6, np.sqrt(GRAVITY / (-2 * az)), 25.0), 1.0, 80.0)
            dz = 2 * az * y[:, 0] + b
            speed = vy * np.sqrt(1 + ax * ax + dz * dz)
            ok = (np.abs(det) > 1e-9 * np.abs(s[0] * s[2] * s[4])) & (line != 0) & np.isfinite(speed)
        return [dict(zip(("trial", "ax", "bx", "az", "bz", "cz", "speed_ms"), v)) for v in zip(*(a[ok].tolist() for a in (kinds, ax, mid - ax * my, az, b, c, speed)))]

    @F.pandas_udf("array<struct<trial: int, ax: double, bx: double, az: double, bz: double, cz: double, speed_ms: double>>")
    def of(trial: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, ray_dist: pd.Series) -> pd.Series:
        return pd.Series([fits(*row) for row in zip(trial, x, y, z, ray_dist)])

    return of


def _trial_hits(threshold: float):
    """How many rows of a chunk are nearer than ``threshold`` to each fit."""

    @F.pandas_udf("array<long>")
    def hits(x: pd.Series, y: pd.Series, z: pd.Series, ax: pd.Series, bx: pd.Series, az: pd.Series, bz: pd.Series, cz: pd.Series) -> pd.Series:
        out = []
        for row in zip(x, y, z, ax, bx, az, bz, cz):
            px, py, pz, *fit = (np.asarray(c, float) for c in row)
            ax_, bx_, az_, bz_, cz_ = (c[:, None] for c in fit)
            dx, dz = ax_ * py + bx_ - px, az_ * py * py + bz_ * py + cz_ - pz
            out.append((np.sqrt(dx * dx + dz * dz) < threshold).sum(axis=1))
        return pd.Series(out)

    return hits


def landing(fits: DataFrame, start: Column, margin: float = 2.0) -> DataFrame:
    """Ground point of each fit: the root of Z(Y) = 0 on court that is furthest from ``start``."""
    disc = F.col("bz") * F.col("bz") - 4 * F.col("az") * F.col("cz")
    ok = (disc >= 0) & (F.abs("az") > 1e-9)
    root = lambda s: F.when(ok, (-F.col("bz") + s * F.sqrt(F.greatest(disc, F.lit(0.0)))) / F.when(ok, 2 * F.col("az")))
    lim = COURT.half_length + margin
    t = fits.withColumns({"_y1": root(1), "_y2": root(-1)})
    on = lambda c: F.when(F.abs(c) <= lim, F.struct(F.abs(F.col(c) - start).alias("d"), F.col(c).alias("y")))
    t = t.withColumn("land_y", F.greatest(on("_y1"), on("_y2"))["y"])
    return t.withColumn("land_x", F.col("ax") * F.col("land_y") + F.col("bx")).drop("_y1", "_y2")


def net_passage(fits: DataFrame, margin: float = 3.0) -> DataFrame:
    """Position, clearance and speed where a fit passes the net; implausible ones are null."""
    z, x = F.col("cz"), F.col("bx")  # the net is at y = 0
    ok = (F.col("y_min") - margin <= 0) & (F.col("y_max") + margin >= 0) & z.between(-1.0, 10.0)
    v = F.least(speed_at(F.lit(0.0)) * 3.6, F.lit(350.0))
    return fits.withColumns({"net_x": F.when(ok, x), "net_z": F.when(ok, z), "clears_net": F.when(ok, z > COURT.net_height), "net_kmh": F.when(ok, v)})


def smooth_curve(fits: DataFrame, keys: Sequence[str], samples: int = 200) -> DataFrame:
    """Evenly spaced points of each fit with plausible heights."""
    t = fits.select(*keys, *COEF, "y_min", "y_max", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    t = t.withColumn("y", F.col("y_min") + (F.col("y_max") - F.col("y_min")) * F.col("i") / (samples - 1))
    t = t.withColumns({"x": F.col("ax") * F.col("y") + F.col("bx"), "z": F.col("az") * F.col("y") * F.col("y") + F.col("bz") * F.col("y") + F.col("cz")})
    return t.where(F.col("z").between(-0.3, 6.0)).select(*keys, "i", "x", "y", "z")


def stroke_rows(rally_rows: DataFrame, bounces: DataFrame) -> DataFrame:
    """Cut rallies at landings; the landing row belongs to the stroke before and the one after."""
    key = ["session_id", "rally"]
    b = bounces.select(*key, "frame", F.lit(1).cast("long").alias("_b"))
    t = rally_rows.join(b, [*key, "frame"], "left")
    t = running(t, key, "frame", sums={"stroke": F.coalesce("_b", F.lit(0).cast("long"))})
    ends = t.where("_b = 1").withColumn("stroke", F.col("stroke") - 1)
    return t.unionByName(ends).drop("_b")


def strokes(rally_rows: DataFrame, bounces: DataFrame, robust: bool = False, trials: int = 100) -> DataFrame:
    """One row per stroke with at least three rows: fit, speed, landing, quality."""
    key = ["session_id", "rally", "stroke"]
    rows = stroke_rows(rally_rows, bounces)
    if robust:
        rows = ransac_fits(rows, key, trials, min_ratio=0.5)
    rows = cut_lineage(rows)
    fits = cut_lineage(parabola_fits(rows, key))
    return landing(fit_quality(rows, fits, key), F.col("y_first"))


def best_split(rally_rows: DataFrame, candidates: DataFrame, gain: float = 0.05, min_rows: int = 3) -> DataFrame:
    """The landing that best splits a rally into two arcs, else its first candidate.

    Candidates per rally are few; each fits the rows before and after it.
    """
    key = ["session_id", "rally"]
    # rows and fits are read by several branches below; each would plan and compute its inputs again
    rows = cut_lineage(row_index(rally_rows, key, "frame"))
    whole = fit_quality(rows, cut_lineage(parabola_fits(rows, key)), key).select(*key, F.col("mean_error").alias("_one"), F.col("n").alias("_n"))
    c = candidates.select(*key, F.col("frame").alias("cut"))
    pos = rows.select(*key, F.col("frame").alias("cut"), F.col("idx").alias("at"))
    c = cut_lineage(c.join(pos, [*key, "cut"]).join(whole, key))
    near = c.where((F.col("at") >= min_rows) & (F.col("_n") - F.col("at") >= min_rows))
    parts = rows.join(near.select(*key, "cut", "at"), key)
    two = cut_lineage(parts.where(F.col("idx") <= F.col("at")).withColumn("part", F.lit(0)).unionByName(parts.where(F.col("idx") >= F.col("at")).withColumn("part", F.lit(1))))
    pk = [*key, "cut", "part"]
    q = fit_quality(two, cut_lineage(parabola_fits(two, pk)), pk).groupBy(*key, "cut").agg((F.sum(F.col("mean_error") * F.col("n")) / F.sum("n")).alias("_two"), F.count("*").alias("_k"))
    g = near.join(q.where("_k = 2"), [*key, "cut"]).withColumn("gain", F.col("_one") - F.col("_two"))
    best = g.groupBy(*key).agg(F.max_by(F.struct("cut", "gain"), F.struct("gain", -F.col("cut"))).alias("b")).where(F.col("b.gain") > gain).select(*key, "b.*")
    first = c.groupBy(*key).agg(F.min("cut").alias("_first"))
    return first.join(best, key, "left").select(*key, F.coalesce("cut", "_first").alias("frame"), F.col("cut").isNotNull().alias("by_fit"))
