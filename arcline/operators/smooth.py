"""Smoothing and gap filling of ordered positions, per gap-free segment.

Every look is bounded in rows inside a segment whose rows are at most ``gap`` frames apart, so
bordered blocks are exact; recursive filters run as chunked folds.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import hypot
from . import ordered
from .fold import fold
from .ordered import BLK, local_segments, neighbour, row_index, running, windowed
from .stats import quantiles

CAM = ["session_id", "camera"]
XY = ("pixel_x", "pixel_y")


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2


def in_segments(df: DataFrame, keys: Sequence[str], gap: int, rows: int, build: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """Run ``build`` with a window limited to the row's segment, looking ``rows`` rows each way."""

    def inner(t: DataFrame, w: WindowSpec) -> DataFrame:
        t = local_segments(t, w, "frame", gap)
        return build(t, Window.partitionBy(*keys, BLK, "_seg").orderBy("frame")).drop("_seg")

    reach = gap * (rows + 1)
    return windowed(df, keys, "frame", inner, reach, reach)


def median_filter(df: DataFrame, k: int, cols: Sequence[str] = XY, keys: Sequence[str] = CAM, gap: int = 3) -> DataFrame:
    h = k // 2
    return in_segments(df, keys, gap, h, lambda t, w: t.withColumns(
        {c: median(F.collect_list(c).over(w.rowsBetween(-h, h))) for c in cols}))


def sg_matrix(window: int, order: int) -> np.ndarray:
    """Row e holds the weights giving the fitted polynomial at position e of the window."""
    a = np.vander(np.arange(window, dtype=float) - window // 2, order + 1)
    return a @ np.linalg.pinv(a)


def sg_smooth(df: DataFrame, window: int, order: int, cols: Sequence[str] = XY, keys: Sequence[str] = CAM, gap: int = 3,
              floor_cols: Sequence[str] = ()) -> DataFrame:
    """Savitzky-Golay smoothing; rows near segment ends take the end polynomial, short segments stay raw."""
    h = window // 2
    proj = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in sg_matrix(window, order)])

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        wide = w.rowsBetween(-(window - 1), window - 1)
        t = t.withColumns({
            "_b": F.count("*").over(w.rowsBetween(-(window - 1), -1)).cast("int"),
            "_a": F.count("*").over(w.rowsBetween(1, window - 1)).cast("int"),
            **{f"_l_{c}": F.collect_list(c).over(wide) for c in cols}})
        b, a = F.col("_b"), F.col("_a")
        start = F.when(b < h, 0).when(a < h, b + a + 1 - window).otherwise(b - h)
        at = F.when(b < h, b).when(a < h, window - 1 - a).otherwise(h)
        t = t.withColumns({"_st": start, "_w": F.element_at(proj, at + 1)})
        out = {}
        for c in cols:
            part = F.slice(F.col(f"_l_{c}"), F.col("_st") + 1, F.lit(window))
            dot = F.aggregate(F.zip_with(part, F.col("_w"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
            dot = F.greatest(dot, F.lit(0.0)) if c in floor_cols else dot
            out[c] = F.when(b + a + 1 >= window, dot).otherwise(F.col(c))
        return t.withColumns(out).drop("_b", "_a", "_st", "_w", *[f"_l_{c}" for c in cols])

    return in_segments(df, keys, gap, window - 1, build)


def bilateral(df: DataFrame, keys: Sequence[str] = CAM, gap: int = 3, jump: float = 50.0, small: float = 20.0) -> DataFrame:
    """Weighted 5-row mean where both neighbouring moves are small; everything else stays raw."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        dp = hypot(*[F.col(c) - F.lag(c).over(w) for c in XY])
        dn = hypot(*[F.lead(c).over(w) - F.col(c) for c in XY])
        calm = (dp <= jump) & (dn <= jump) & (dp < small) & (dn < small)
        out = {}
        for c in XY:
            terms = [(1.0 / (1 + abs(k)), F.lag(c, -k).over(w) if k else F.col(c)) for k in (-2, -1, 0, 1, 2)]
            num = sum((F.coalesce(v * g, F.lit(0.0)) for g, v in terms[1:]), F.coalesce(terms[0][1] * terms[0][0], F.lit(0.0)))
            den = sum((F.when(v.isNotNull(), g).otherwise(0.0) for g, v in terms[1:]), F.when(terms[0][1].isNotNull(), terms[0][0]).otherwise(0.0))
            out[f"_s_{c}"] = F.when(F.coalesce(calm, F.lit(False)), num / den).otherwise(F.col(c))
        return t.withColumns(out).withColumns({c: F.col(f"_s_{c}") for c in XY}).drop(*[f"_s_{c}" for c in XY])

    return in_segments(df, keys, gap, 2, build)


def confidence_weighted(df: DataFrame, keys: Sequence[str] = CAM, gap: int = 3, window: int = 5, conf: str = "blob_sum") -> DataFrame:
    """Blend of the raw row and its local mean; surer rows keep more of themselves."""
    span = df.groupBy(*keys).agg(F.min(conf).alias("_lo"), F.max(conf).alias("_hi"))
    c = F.when(F.col("_hi") > F.col("_lo"), (F.col(conf) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    t = df.join(span, list(keys)).withColumn("_al", 0.3 + 0.7 * c).drop("_lo", "_hi")
    h = window // 2

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        al = F.col("_al")
        out = {f"_s_{v}": al * F.col(v) + (1 - al) * F.avg(v).over(w.rowsBetween(-h, h)) for v in XY}
        return t.withColumns(out).withColumns({v: F.col(f"_s_{v}") for v in XY}).drop(*out)

    return in_segments(t, keys, gap, h, build).drop("_al")


def ema(df: DataFrame, alpha: float, keys: Sequence[str] = CAM, gap: int = 3, fast: float | None = None, speed: float = 25.0) -> DataFrame:
    """Exponential mean; with ``fast`` the weight rises to it while the raw move exceeds ``speed``."""

    def step(state, row):
        f, x, y = int(row.frame), float(row.pixel_x), float(row.pixel_y)
        if state["f"] is None or f - state["f"] > gap:
            state["s"] = [x, y]
        else:
            a = alpha
            if fast is not None:
                a = fast if ((x - state["r"][0]) ** 2 + (y - state["r"][1]) ** 2) ** 0.5 > speed else alpha
            state["s"] = [a * x + (1 - a) * state["s"][0], a * y + (1 - a) * state["s"][1]]
        state["f"], state["r"] = f, [x, y]
        return [(f, *state["s"])]

    return fold(df.select(*keys, "frame", *XY), keys, "frame", {"f": None, "s": None, "r": None}, step,
                "frame long, pixel_x double, pixel_y double")


def kalman(df: DataFrame, q: float = 50.0, r: float = 5.0, reject: float = 200.0, keys: Sequence[str] = CAM, gap: int = 10,
           smoothed: bool = True, skip_outliers: bool = False, start_var: float = 100.0, fps: float = 25.0) -> DataFrame:
    """Constant-velocity filter. Both axes share one 2x2 covariance, so the state is seven numbers.

    Outliers restart the filter, or are skipped (``skip_outliers``); ``smoothed=False`` uses the
    filter as a gate only and returns raw rows.
    """
    dt, qp, qv, rr = 1.0 / fps, 0.1 * q, q, r * r

    def fresh(x, y):
        return [x, 0.0, y, 0.0, start_var, 0.0, start_var]

    def step(state, row):
        f, x, y = int(row.frame), float(row.pixel_x), float(row.pixel_y)
        last, state["f"] = state["f"], f
        if last is None or f - last > gap:
            state["k"] = fresh(x, y)
            if last is not None:
                return [(f, x, y)]
        g = 0 if last is None else f - last
        px, vx, py, vy, a, b, c = state["k"]
        h = dt * g
        px, py = px + h * vx, py + h * vy
        a, b, c = a + 2 * h * b + h * h * c + qp * g, b + h * c, c + qv * g
        ix, iy = x - px, y - py
        if (ix * ix + iy * iy) ** 0.5 < reject:
            k0, k1 = a / (a + rr), b / (a + rr)
            px, vx, py, vy = px + k0 * ix, vx + k1 * ix, py + k0 * iy, vy + k1 * iy
            state["k"] = [px, vx, py, vy, (1 - k0) * a, (1 - k0) * b, c - k1 * b]
            return [(f, px, py)] if smoothed else [(f, x, y)]
        if skip_outliers:
            state["k"] = [px, vx, py, vy, a, b, c]
            return []
        state["k"] = fresh(x, y)
        return [(f, x, y)]

    return fold(df.select(*keys, "frame", *XY), keys, "frame", {"f": None, "k": None}, step,
                "frame long, pixel_x double, pixel_y double")


def fill_linear(df: DataFrame, cols: Sequence[str] = XY, keys: Sequence[str] = CAM, max_gap: int = 4) -> DataFrame:
    """Add rows inside gaps of 2..max_gap frames by linear interpolation."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        return t.withColumns({f"_n_{c}": F.lead(c).over(w) for c in ["frame", *cols]})

    t = windowed(df.select(*keys, "frame", *cols), keys, "frame", build, 0, max_gap + 1)
    gap = F.col("_n_frame") - F.col("frame")
    g = F.explode(F.sequence(F.lit(0), F.when(gap.between(2, max_gap), gap - 1).otherwise(F.lit(0)).cast("int")))
    t = t.withColumn("_g", g)
    share = F.col("_g") / gap
    out = [(F.col("frame") + F.col("_g")).alias("frame")]
    out += [F.when(F.col("_g") == 0, F.col(c)).otherwise(F.col(c) + share * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols]
    return t.select(*keys, *out, (F.col("_g") > 0).alias("filled"))


def fill_quadratic(df: DataFrame, keys: Sequence[str] = CAM, max_gap: int = 3, look: int = 10, size: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """Fill gaps of up to ``max_gap`` missing frames by a parabola through two rows on each side.

    Three context rows give the exact parabola, four its least-squares fit, two a line; the sums
    are taken relative to the gap start.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        s = F.struct("frame", *XY)
        return t.withColumns({"_p": F.lag(s).over(w), "_n": F.lead(s).over(w), "_m": F.lead(s, 2).over(w)})

    t = windowed(df.select(*keys, "frame", *XY), keys, "frame", build, look + 1, max_gap + look + 2)
    gap = F.col("_n")["frame"] - F.col("frame")
    t = t.where(gap.between(2, max_gap + 1))
    here = F.struct("frame", *XY)
    p = F.when(F.col("frame") - F.col("_p")["frame"] <= look, F.col("_p"))
    m = F.when(F.col("_m")["frame"] - F.col("_n")["frame"] <= look, F.col("_m"))
    ctx = F.filter(F.array(p, here, F.col("_n"), m), lambda c: c.isNotNull())
    t = t.select(*keys, F.col("frame").alias("_f"), ctx.alias("_ctx"), (gap - 1).alias("_len"))
    total = lambda fn: F.aggregate("_ctx", F.lit(0.0), lambda a, c: a + fn(c))
    d = lambda c: (c["frame"] - F.col("_f")).cast("double")
    t = t.withColumns({f"_s{k}": total(lambda c, k=k: F.pow(d(c), F.lit(float(k)))) for k in range(5)} | {
        f"_{v}{k}": total(lambda c, k=k, v=v: F.pow(d(c), F.lit(float(k))) * c[v]) for v in XY for k in range(3)})
    t = t.withColumn("_g", F.explode(F.sequence(F.lit(1), F.col("_len").cast("int"))))
    out = [(F.col("_f") + F.col("_g")).alias("frame")]
    for v, top in zip(XY, size):
        val = poly_at([F.col(f"_s{k}") for k in range(5)], [F.col(f"_{v}{k}") for k in range(3)], F.col("_g").cast("double"))
        out.append(F.least(F.greatest(val, F.lit(0.0)), F.lit(float(top))).alias(v))
    return t.select(*keys, *out)


def poly_at(s: list[Column], b: list[Column], at: Column) -> Column:
    """Value at ``at`` of the least-squares parabola (a line with two rows) from moment sums."""
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    d0 = b[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (b[1] * s[4] - s[3] * b[2]) + s[2] * (b[1] * s[3] - s[2] * b[2])
    d1 = s[0] * (b[1] * s[4] - b[2] * s[3]) - b[0] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * b[2] - b[1] * s[2])
    d2 = s[0] * (s[2] * b[2] - s[3] * b[1]) - s[1] * (s[1] * b[2] - s[2] * b[1]) + b[0] * (s[1] * s[3] - s[2] * s[2])
    line_det = s[0] * s[2] - s[1] * s[1]
    l0, l1 = F.try_divide(b[0] * s[2] - s[1] * b[1], line_det), F.try_divide(s[0] * b[1] - s[1] * b[0], line_det)
    curve = F.try_divide(d0, det) + F.try_divide(d1, det) * at + F.try_divide(d2, det) * at * at
    return F.when(s[0] > 2, curve).otherwise(l0 + l1 * at)


def median_outliers(top: DataFrame, cands: DataFrame, keys: Sequence[str] = CAM, half: int = 4, max_px: float = 150.0) -> DataFrame:
    """Replace rows far from the local median by the nearest candidate of their frame, or drop them.

    Neighbours are up to ``half`` rows and ``2 * half`` frames away; fewer than three keep the row.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.collect_list(F.struct("frame", *XY)).over(w.rowsBetween(-half, half))
        close = F.filter(near, lambda s: F.abs(s["frame"] - F.col("frame")) <= 2 * half)
        t = t.withColumn("_c", close)
        return t.withColumns({f"_m_{v}": F.when(F.size("_c") >= 3, median(F.transform("_c", lambda s: s[v]))) for v in XY}).drop("_c")

    # rows further than 2 * half frames are filtered out anyway, so that is the reach
    t = windowed(top.select(*keys, "frame", *XY), keys, "frame", build, 2 * half, 2 * half)
    d = hypot(*[F.col(v) - F.col(f"_m_{v}") for v in XY])
    keep = t.where(d.isNull() | (d <= max_px)).select(*keys, "frame", *XY, F.lit("kept").alias("origin"))
    bad = t.where(d > max_px).select(*keys, "frame", *[f"_m_{v}" for v in XY])
    j = bad.join(cands.select(*keys, "frame", "rank", *XY), [*keys, "frame"])
    dc = hypot(*[F.col(v) - F.col(f"_m_{v}") for v in XY])
    best = j.groupBy(*keys, "frame").agg(F.min_by(F.struct(*XY, dc.alias("d")), F.struct(dc.alias("d"), "rank")).alias("b"))
    again = best.where(F.col("b.d") <= max_px).select(*keys, "frame", *[F.col(f"b.{v}").alias(v) for v in XY], F.lit("reselected").alias("origin"))
    return keep.unionByName(again)


def _with_options(top: DataFrame, cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the few candidates of their frame in order of rank."""
    c = cands.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("rank", *XY))).alias("cands"))
    return top.join(c, [*keys, "frame"], "left")


def _options(row) -> list[tuple[float, float]]:
    return [(float(k["pixel_x"]), float(k["pixel_y"])) for k in (row.cands if row.cands is not None else [])]


def velocity_outliers(top: DataFrame, cands: DataFrame, keys: Sequence[str] = CAM, max_v: float = 200.0) -> DataFrame:
    """Rows that jump away from both neighbours while those agree take the candidate nearest to the middle of the two, if near, or go.

    The row before is the corrected one (the last that stayed), so this is a fold; each row carries its own next row.
    """
    nxt = neighbour(top.select(*keys, "frame", *XY), keys, "frame", next={"nx": (None, F.struct("frame", *XY))})
    rows = _with_options(nxt, cands, keys)

    def gone(a, b):
        return ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 / max(abs(a[0] - b[0]), 1)

    def step(state, row):
        cur = [int(row.frame), float(row.pixel_x), float(row.pixel_y)]
        p, n = state["p"], row.nx
        if p is not None and n is not None:
            n = [int(n["frame"]), float(n["pixel_x"]), float(n["pixel_y"])]
            if gone(cur, p) > max_v and gone(n, cur) > max_v and gone(n, p) < max_v:
                mid = (p[1] + n[1]) / 2, (p[2] + n[2]) / 2
                best = min(_options(row), key=lambda k: math.hypot(k[0] - mid[0], k[1] - mid[1]), default=None)
                if best is None or math.hypot(best[0] - mid[0], best[1] - mid[1]) >= max_v:
                    return []
                cur = [cur[0], *best]
        state["p"] = cur
        return [tuple(cur)]

    return fold(rows, keys, "frame", {"p": None}, step, "frame long, pixel_x double, pixel_y double")


def reselect_by_anchors(top: DataFrame, cands: DataFrame, keys: Sequence[str] = CAM, near: float = 5.0, closer_by: float = 15.0, look: int = 15, pair: int = 10) -> DataFrame:
    """Swap a row for a candidate clearly nearer to where the anchors around it point.

    Anchors are rows with a candidate within ``near`` pixels. Between two anchors the place is interpolated; with
    anchors on one side only it follows the last two of them, or stays at the only one. Anchors before a row are read
    as corrected, those after it as they came: the corrected ones are the fold's memory, the others a window ahead.
    """
    t = _with_options(top.select(*keys, "frame", *XY), cands, keys)
    close = F.exists(F.coalesce("cands", F.array()), lambda c: hypot(c["pixel_x"] - F.col("pixel_x"), c["pixel_y"] - F.col("pixel_y")) < near)
    t = row_index(t.withColumn("anchor", F.coalesce(close, F.lit(False))), keys, "frame")
    reach = look + pair - 2
    ahead = F.when(F.col("anchor"), F.struct("idx", "frame", *XY))
    t = windowed(t, keys, "idx", lambda t, w: t.withColumn("next", F.collect_list(ahead).over(w.rowsBetween(1, reach))), 0, reach)

    def along(a, b, f):
        """Through a and b (frame, x, y) to frame f; a alone if there is no b."""
        if b is None:
            return a[1:]
        d = max(abs(a[0] - b[0]), 1)
        return [a[k] + (a[k] - b[k]) / d * abs(f - a[0]) for k in (1, 2)]

    def step(state, row):
        i, f, cur = int(row.idx), int(row.frame), [float(row.pixel_x), float(row.pixel_y)]
        past = [p for p in state["p"] if p[0] >= i - look - pair]
        p = past[-1] if past and past[-1][0] >= i - look else None
        p2 = past[-2] if p and len(past) > 1 and past[-2][0] >= p[0] - pair else None
        nxt = [[int(k["idx"]), int(k["frame"]), float(k["pixel_x"]), float(k["pixel_y"])] for k in row.next]
        n = nxt[0] if nxt and nxt[0][0] < i + look else None
        n2 = nxt[1] if n and len(nxt) > 1 and nxt[1][0] < n[0] + pair else None
        if p or n:
            if p and n:
                w = (f - p[1]) / max(n[1] - p[1], 1)
                guess = [p[k] * (1 - w) + n[k] * w for k in (2, 3)]
            else:
                guess = along(p[1:], p2 and p2[1:], f) if p else along(n[1:], n2 and n2[1:], f)
            dist = lambda q: math.hypot(q[0] - guess[0], q[1] - guess[1])
            here = dist(cur)
            best = min(_options(row), key=dist, default=None)
            if here >= closer_by and best and dist(best) < here - closer_by:
                cur = list(best)
        state["p"] = [*past, [i, f, *cur]] if row.anchor else past
        return [(f, *cur)]

    return fold(t, keys, "idx", {"p": []}, step, "frame long, pixel_x double, pixel_y double")


def steadiest(sides: list[list[tuple]]) -> list[tuple]:
    """The side (rows of frame, x, y) of least variance, the first of equal ones.

    Plain sums are right to far less than the margin they must decide by; what is nearer than that, or equal, is told
    apart in exact arithmetic, which costs a hundred times as much.
    """

    def plain(ps):
        total = 0.0
        for k in (1, 2):
            v = [p[k] for p in ps]
            mean = math.fsum(v) / len(v)
            total += math.fsum((u - mean) ** 2 for u in v) / len(v)
        return total

    def exact(ps):
        return sum(statistics.pvariance([p[k] for p in ps]) for k in (1, 2))

    rough = [plain(s) for s in sides]
    low = min(rough)
    if not low < math.inf:
        return min(sides, key=exact)
    close = [s for s, v in zip(sides, rough) if v <= low * (1 + 1e-9) + 1e-9]
    return close[0] if len(close) == 1 else min(close, key=exact)


def reselect_by_sides(top: DataFrame, cands: DataFrame, keys: Sequence[str] = CAM, half: int = 5, closer_by: float = 20.0) -> DataFrame:
    """Swap a row for a candidate nearer to the median of the steadiest of three sides: rows before, rows after, both.

    Sides hold up to ``half`` rows and three times as many frames; the one of least variance counts (the first of
    equal ones). Rows before are read as corrected, rows after as they came. A candidate must win by ``closer_by``
    over the best so far.
    """
    t = _with_options(top.select(*keys, "frame", *XY), cands, keys)
    t = row_index(t, keys, "frame")
    t = windowed(t, keys, "idx", lambda t, w: t.withColumn("next", F.collect_list(F.struct("frame", *XY)).over(w.rowsBetween(1, half))), 0, half)

    def step(state, row):
        f, cur = int(row.frame), (float(row.pixel_x), float(row.pixel_y))
        before = [p for p in state["p"] if f - p[0] <= 3 * half]
        after = [(int(k["frame"]), float(k["pixel_x"]), float(k["pixel_y"])) for k in row.next]
        after = [p for p in after if p[0] - f <= 3 * half]
        sides = [s for s in (before, after, [*before, *after]) if len(s) >= 2]
        if sides:
            side = steadiest(sides)
            mid = [statistics.median([p[k] for p in side]) for k in (1, 2)]
            best = math.hypot(cur[0] - mid[0], cur[1] - mid[1])
            for c in _options(row):
                d = math.hypot(c[0] - mid[0], c[1] - mid[1])
                if d < best - closer_by:
                    best, cur = d, c
        state["p"] = [*state["p"], [f, *cur]][-half:]
        return [(f, *cur)]

    return fold(t, keys, "idx", {"p": []}, step, "frame long, pixel_x double, pixel_y double")


def pick_by_proximity(cands: DataFrame, keys: Sequence[str] = CAM, speed: float = 80.0, gap: int = 5, near: float = 0.7, conf: str = "conf") -> DataFrame:
    """One candidate a frame: how near it is to the last pick, against the reach of ``speed`` pixels a frame, and its confidence.

    Without a pick in the last ``gap`` frames the first ranked one is taken.
    """
    c = cands.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("rank", *XY, F.col(conf).cast("double").alias("conf")))).alias("cands"))

    def step(state, row):
        f, last = int(row.frame), state["p"]
        best = row.cands[0]
        if last is not None and f - last[0] <= gap:
            reach = speed * (f - last[0])

            def score(k):
                d = math.hypot(k["pixel_x"] - last[1], k["pixel_y"] - last[2])
                return near * (1.0 - d / reach if d <= reach else 0.0) + (1 - near) * k["conf"]

            best = max(row.cands, key=lambda k: (score(k), -k["rank"]))
        state["p"] = [f, float(best["pixel_x"]), float(best["pixel_y"])]
        return [(f, int(best["rank"]), *state["p"][1:])]

    return fold(c, keys, "frame", {"p": None}, step, "frame long, rank long, pixel_x double, pixel_y double")


def drop_static(cands: DataFrame, cell: float = 40.0, decay: float = 0.98, limit: float = 30.0, keys: Sequence[str] = CAM, width: int = 2048) -> DataFrame:
    """Suppress candidates in pixel cells whose decayed hit count has reached ``limit``.

    All candidates of a frame count before any of them is judged; counts decay by the frames passed. Sums are
    taken inside blocks of ``width`` frames and carried over one block: what lies further back weighs less than
    ``decay ** width`` (1e-18), below the precision of the sum.
    """
    part = [*keys, "cx", "cy"]
    t = cands.withColumns({"cx": F.floor(F.col("pixel_x") / cell).cast("long"), "cy": F.floor(F.col("pixel_y") / cell).cast("long")}).select(*part, "frame", "rank")
    n = t.groupBy(*part, "frame").agg(F.count("*").alias("n")).withColumn("_b", F.floor(F.col("frame") / width))
    since = F.col("frame") - F.col("_b") * width
    w = Window.partitionBy(*part, "_b").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.col("n") * F.pow(F.lit(decay), -since)).over(w) * F.pow(F.lit(decay), since)
    n = n.withColumn("_own", F.coalesce(earlier, F.lit(0.0)) + F.col("n"))
    carry = n.groupBy(*part, "_b").agg(F.sum(F.col("n") * F.pow(F.lit(decay), width - since)).alias("_carry")).withColumn("_b", F.col("_b") + 1)
    n = n.join(carry, [*part, "_b"], "left")
    n = n.select(*part, "frame", (F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(decay), since)).alias("heat"))
    return t.join(n, [*part, "frame"]).select(*keys, "frame", "rank", "heat", (F.col("heat") < limit).alias("kept"))


def confident(df: DataFrame, q: float = 0.2, keys: Sequence[str] = CAM, conf: str = "blob_sum") -> DataFrame:
    """Rows at or above the exact ``q`` quantile of confidence of their camera."""
    return df.join(quantiles(df, keys, conf, {"_q": q}), list(keys)).where(F.col(conf) >= F.col("_q")).drop("_q")


# Named methods: a method is a chain of DataFrame steps.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw": lambda d: d,
    "conf20": lambda d: confident(d, 0.2),
    "conf25": lambda d: confident(d, 0.25),
    "conf30": lambda d: confident(d, 0.3),
    "conf40": lambda d: confident(d, 0.4),
    **{f"median{k}": (lambda d, k=k: median_filter(d, k)) for k in (3, 5, 7)},
    **{f"sg{w}_{p}": (lambda d, w=w, p=p: sg_smooth(d, w, p)) for w, p in ((5, 2), (7, 2), (7, 3), (11, 3))},
    **{f"ema{int(a * 10)}": (lambda d, a=a: ema(d, a)) for a in (0.3, 0.5, 0.7)},
    "ema_adaptive": lambda d: ema(d, 0.5, fast=0.9),
    "kalman": lambda d: kalman(d),
    "kalman_tuned": lambda d: kalman(d, 20.0, 8.0),
    "kalman_light": lambda d: kalman(d, 100.0, 3.0),
    "bilateral": bilateral,
    "conf_weighted": confidence_weighted,
    "conf20_median5": lambda d: median_filter(confident(d, 0.2), 5),
    "conf20_sg7": lambda d: sg_smooth(confident(d, 0.2), 7, 2),
    "conf20_bilateral": lambda d: bilateral(confident(d, 0.2)),
    "conf20_ema5": lambda d: ema(confident(d, 0.2), 0.5),
    "conf20_kalman": lambda d: kalman(confident(d, 0.2)),
    "median3_bilateral": lambda d: bilateral(median_filter(d, 3)),
    "median3_ema7": lambda d: ema(median_filter(d, 3), 0.7),
    "median5_sg7": lambda d: sg_smooth(median_filter(d, 5), 7, 2),
    "best": lambda d: median_filter(confident(d, 0.2), 5),
}
