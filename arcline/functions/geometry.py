"""Planar projection and two-ray triangulation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..court import COURT, CourtSpec


def _project(m: str, u: Column, v: Column) -> tuple[Column, Column]:
    h = [F.col(f"{m}{i}{j}") for i in range(3) for j in range(3)]
    d = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / d, (h[3] * u + h[4] * v + h[5]) / d


def pixel_to_world(df: DataFrame, cameras: DataFrame, px: str = "pixel_x", py: str = "pixel_y",
                   out: tuple[str, str] = ("world_x", "world_y")) -> DataFrame:
    """Apply each row's camera matrix (image to ground plane)."""
    x, y = _project("h", F.col(px), F.col(py))
    return _with_camera(df, cameras, "h", {out[0]: x, out[1]: y})


def world_to_pixel(df: DataFrame, cameras: DataFrame, wx: str = "world_x", wy: str = "world_y",
                   out: tuple[str, str] = ("pixel_x", "pixel_y")) -> DataFrame:
    x, y = _project("g", F.col(wx), F.col(wy))
    return _with_camera(df, cameras, "g", {out[0]: x, out[1]: y})


def _with_camera(df: DataFrame, cameras: DataFrame, m: str, cols: dict[str, Column]) -> DataFrame:
    mat = [f"{m}{i}{j}" for i in range(3) for j in range(3)]
    return df.join(cameras.select("camera", *mat), "camera").withColumns(cols).drop(*mat)


def in_court_x(x: Column, margin: float = 1.0, width: float = 8.23) -> Column:
    return x.between(-width / 2 - margin, width / 2 + margin)


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def triangulated(
    df: DataFrame, a: str, b: str, cam_a: tuple, cam_b: tuple,
    bounded: bool = True, resolve: bool = True, parallel_dist: float | None = 999.0,
    out: tuple[str, str, str, str] = ("x", "y", "z", "ray_dist"),
) -> DataFrame:
    """Closest approach of the two camera rays through ground points ``{a}_x/_y`` and ``{b}_x/_y``.

    ``bounded`` keeps the ray parameters in [0, 1] (else >= 0); ``resolve`` refits each parameter
    once after clipping. Near-parallel rays fall back to the ground midpoint with
    ``parallel_dist`` (None drops the position). Built in stages so each product is computed once.
    """
    keep = [c for c in df.columns if c not in out]
    c1, c2 = [float(v) for v in cam_a], [float(v) for v in cam_b]
    w = [m - n for m, n in zip(c1, c2)]
    ax, ay, bx, by = (F.col(f"{n}_{axis}") for n in (a, b) for axis in "xy")
    t = df.withColumns({"_p0": ax - c1[0], "_p1": ay - c1[1], "_q0": bx - c2[0], "_q1": by - c2[1]})
    p, q = [F.col("_p0"), F.col("_p1"), F.lit(-c1[2])], [F.col("_q0"), F.col("_q1"), F.lit(-c2[2])]
    t = t.withColumns({
        "_pp": _dot(p, p), "_pq": _dot(p, q), "_qq": _dot(q, q),
        "_pw": p[0] * w[0] + p[1] * w[1] - c1[2] * w[2], "_qw": q[0] * w[0] + q[1] * w[1] - c2[2] * w[2]})
    pp, pq, qq, pw, qw = (F.col(n) for n in ("_pp", "_pq", "_qq", "_pw", "_qw"))
    t = t.withColumn("_det", pp * qq - pq * pq)
    clip = _clip01 if bounded else lambda c: F.greatest(c, F.lit(0.0))
    s_free, t_free = clip(F.try_divide(pq * qw - qq * pw, F.col("_det"))), clip(F.try_divide(pp * qw - pq * pw, F.col("_det")))
    if bounded and resolve:
        t = t.withColumn("_s", s_free)
        t = t.withColumn("_t", _clip01((qw + F.col("_s") * pq) / qq))
        t = t.withColumn("_s", _clip01((F.col("_t") * pq - pw) / pp))
    else:
        t = t.withColumns({"_s": s_free, "_t": t_free})
    sp, tq = [F.col("_s") * v for v in p], [F.col("_t") * v for v in q]
    flat = F.abs("_det") < 1e-10
    ground = [(ax + bx) / 2, (ay + by) / 2, F.lit(0.0)]
    if parallel_dist is None:
        ground = [F.lit(None).cast("double")] * 3
    mid = [(c1[i] + c2[i] + sp[i] + tq[i]) / 2 for i in range(3)]
    mid[2] = F.greatest(mid[2], F.lit(0.0))
    gap = hypot(*[w[i] + sp[i] - tq[i] for i in range(3)])
    vals = [F.when(flat, g).otherwise(m) for g, m in zip(ground, mid)]
    vals.append(F.when(flat, F.lit(parallel_dist).cast("double")).otherwise(gap))
    return t.select(*keep, *[v.alias(o) for v, o in zip(vals, out)])


def _dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def ground_projection(df: DataFrame, cam: tuple, out: tuple[str, str] = ("world_x", "world_y")) -> DataFrame:
    """Where the line from the camera through the ball meets the ground (inverse of the above)."""
    k = F.lit(cam[2]) / (F.lit(cam[2]) - F.col("z"))
    return df.withColumns({out[0]: F.lit(cam[0]) + (F.col("x") - cam[0]) * k, out[1]: F.lit(cam[1]) + (F.col("y") - cam[1]) * k})


def judge(x: Column, y: Column, court: CourtSpec = COURT) -> Column:
    """Why a landing is in or out; the first rule that holds wins."""
    return (
        F.when(F.abs(y) < court.net_zone, "net")
        .when(F.abs(x) > court.half_width, "wide")
        .when(F.abs(y) > court.half_length, "long")
        .otherwise("in")
    )


def side(y: Column) -> Column:
    return F.when(y < COURT.net_y, "near").otherwise("far")


def hypot(*parts: Column) -> Column:
    return F.sqrt(sum((F.pow(p, F.lit(2.0)) for p in parts[1:]), F.pow(parts[0], F.lit(2.0))))
