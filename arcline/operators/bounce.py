"""Landing (bounce) detection on the height signal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .cooldown import first_wins, last_better, lowest_in_group
from .motion import KEYS, RALLY
from .ordered import neighbour, windowed

# Fixed values of the report rules.
Z_MIN, Z_MAX, DEDUP_FRAMES, MAX_PER_RALLY = 0.02, 0.25, 10, 8
ROLL_Z, ROLL_GAP = 0.05, 30


def low_points(rally_rows: DataFrame, max_row_gap: int = 26) -> DataFrame:
    """Strict local minima of height near the ground and court, two rows away from rally ends."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        z = F.col("z")
        hit = (
            F.lag("z", 2).over(w).isNotNull() & F.lead("z", 2).over(w).isNotNull()
            & (z > Z_MIN) & (z < Z_MAX) & (z < F.lag("z").over(w)) & (z < F.lead("z").over(w))
            & (F.abs("x") < 7) & (F.abs("y") < 14))
        return t.withColumn("_hit", hit)

    reach = 2 * max_row_gap
    return windowed(rally_rows, RALLY, "frame", build, reach, reach).where("_hit").select(*RALLY, "frame", "x", "y", "z")


def lowest_per_group(cand: DataFrame, keys: list[str], span: int = DEDUP_FRAMES) -> DataFrame:
    """Groups start at a row and take all rows within ``span`` frames of it; keep the lowest."""
    return lowest_in_group(cand.select(*keys, "frame", "x", "y", "z"), keys, span, "z")


def drop_rolling(cand: DataFrame, keys: list[str], roll_z: float = ROLL_Z, gap: int = ROLL_GAP) -> DataFrame:
    """After a low row, following low rows each within ``gap`` frames of the one before are dropped."""
    t = neighbour(cand, keys, "frame", prev={"_p": (None, F.struct("frame", "z"))})
    p = F.col("_p")
    rolling = (F.col("z") < roll_z) & (p["z"] < roll_z) & (F.col("frame") - p["frame"] <= gap)
    return t.where(~F.coalesce(rolling, F.lit(False))).drop("_p")


def cap_by_height(bounces: DataFrame, shots: DataFrame, cap: int = MAX_PER_RALLY) -> DataFrame:
    """A rally cannot have many more landings than shots: keep the lowest ones."""
    w = Window.partitionBy(*RALLY).orderBy("z", "frame")
    t = bounces.join(shots, RALLY, "left").withColumn("_cap", F.least(F.coalesce("shots", F.lit(0)) + 2, F.lit(cap)))
    return t.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= cap) & (F.col("_rn") <= F.col("_cap"))).drop("_cap", "_rn", "shots")


def report_bounces(rally_rows: DataFrame, shots: DataFrame, max_row_gap: int = 26) -> DataFrame:
    t = lowest_per_group(low_points(rally_rows, max_row_gap), RALLY)
    return cap_by_height(drop_rolling(t, RALLY), shots)


def smoothed_height(points: DataFrame) -> DataFrame:
    """Three-row mean height with row positions."""
    from .ordered import row_index
    from .peaks import smooth3

    return smooth3(row_index(points, KEYS, "frame"), KEYS, "z", "zs")


def peak_bounces(points: DataFrame, z_max: float = 0.5, prominence: float = 0.10, min_rows: int = 5, z_min: float | None = 0.02) -> DataFrame:
    """Landings as prominent dips of the smoothed height."""
    from ..court import COURT, in_court
    from .peaks import find_peaks

    s = smoothed_height(points).withColumn("_neg", -F.col("zs"))
    p = find_peaks(s, KEYS, "_neg", min_rows, prominence)
    low = F.lit(True) if z_min is None else F.col("zs") > z_min
    return p.where(low & (F.col("zs") <= z_max)).select(
        *KEYS, "frame", "x", "y", F.col("zs").alias("z"), in_court(F.col("x"), F.col("y"), COURT.in_margin).alias("in_court"))


def events(points: DataFrame, fps: float = 25.0, z_max: float = 0.5, prominence: float = 0.10, jump: float = 15.0, clear: int = 4) -> DataFrame:
    """Bounces, shots (sudden speed change well above the ground, away from bounces) and the serve.

    The serve is the first shot of a session made behind the baseline zone.
    """
    from ..functions.geometry import hypot
    from .joins import band_join

    b = peak_bounces(points, z_max, prominence, z_min=None)

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        d = lambda c: F.col(c) - F.lag(c).over(w)
        dt = d("frame") / fps
        t = t.withColumn("_v", hypot(d("x") / dt, d("y") / dt, d("zs") / dt))
        return t.withColumn("_dv", F.abs(F.lead("_v").over(w) - F.col("_v")))

    s = windowed(smoothed_height(points), KEYS, "idx", build, 1, 2)
    shots = s.where((F.col("_dv") > jump) & (F.col("zs") > z_max)).select(*KEYS, "frame", "x", "y", F.col("zs").alias("z"))
    shots = band_join(shots, b.select(*KEYS, F.col("frame").alias("bf")), KEYS, "frame", "bf", clear, clear, "left_anti")
    first = shots.where(F.abs("y") > 8).groupBy(*KEYS).agg(F.min("frame").alias("_sf"))
    kind = F.when(F.col("frame") == F.col("_sf"), "serve").otherwise("shot")
    shots = shots.join(first, KEYS, "left").withColumn("kind", kind)
    cols = [*KEYS, "frame", "x", "y", "z", "kind"]
    return b.withColumn("kind", F.lit("bounce")).select(*cols).unionByName(shots.select(*cols))


def simple_minima(points: DataFrame, z_max: float = 0.3) -> DataFrame:
    """Annotation rule: rows lower than both neighbours and below ``z_max``."""
    from .ordered import row_index

    t = windowed(row_index(points, KEYS, "frame"), KEYS, "idx", lambda t, w: t.withColumn(
        "_hit", (F.col("z") < z_max) & (F.col("z") < F.lag("z").over(w)) & (F.col("z") < F.lead("z").over(w))), 1, 1)
    return t.where("_hit").select(*KEYS, "frame", "x", "y", "z")


def robust_minima(rally_rows: DataFrame, z_max: float = 0.5, rise: float = 0.05, look: int = 3, merge: int = 3) -> DataFrame:
    """All minima of a rally with a clear rise within ``look`` rows on both sides; minima nearer
    than ``merge`` rows keep the lowest."""
    from .ordered import row_index

    keys = ["session_id", "rally"]

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        z = F.col("z")
        up = lambda a, b: F.coalesce(F.max("z").over(w.rowsBetween(a, b)) > z + rise, F.lit(False))
        hit = (z < z_max) & (z <= F.lag("z").over(w)) & (z <= F.lead("z").over(w)) & up(1, look) & up(-look, -1)
        return t.withColumn("_hit", F.coalesce(hit, F.lit(False)))

    t = windowed(row_index(rally_rows, keys, "frame"), keys, "idx", build, look, look).where("_hit")

    return last_better(t.select(*keys, "idx", "frame", "x", "y", "z"), keys, merge, -F.col("z"), "idx")


def _split_ratio(frames, zs, halves):
    """Best joint-to-split residual ratio of parabolas around the middle row of each list."""
    import numpy as np

    def mse(t, z):
        v = np.vander(t - t.mean(), 3)
        return float(np.mean((z - v @ np.linalg.lstsq(v, z, rcond=None)[0]) ** 2))

    out = []
    for f, z in zip(frames, zs):
        f, z = np.asarray(f, float) / 25.0, np.asarray(z, float)
        m, best = len(f) // 2, 0.0
        for h in halves:
            l, r, j = slice(m - h, m + 1), slice(m, m + h + 1), slice(m - h, m + h + 1)
            split = (mse(f[l], z[l]) + mse(f[r], z[r])) / 2
            best = max(best, mse(f[j], z[j]) / split if split > 1e-8 else 0.0)
        out.append(best)
    return out


def hybrid_signals(points: DataFrame, v_rows: int, halves: tuple[int, ...], z_max: float, gap: int, dense: int, min_speed: float,
                   min_before: int, min_after: int) -> DataFrame:
    """Landing candidates from two signals: a V in the height and a better fit by two parabolas.

    All looks are bounded in rows of one gap-free segment; the parabola ratio is computed on
    the rows that passed the cheap gates only.
    """
    from ..court import COURT, FPS
    from ..functions.geometry import hypot
    from .smooth import in_segments

    m = max(max(halves), v_rows)

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        plain = Window.partitionBy(*KEYS, "_blk").orderBy("frame")
        wide = w.rowsBetween(-m, m)
        p = F.struct("frame", "x", "y", "z")
        t = t.withColumns({
            "_before": F.count("*").over(w.rowsBetween(-min_before, -1)), "_after": F.count("*").over(w.rowsBetween(1, min_after)),
            "_mb": F.avg("z").over(w.rowsBetween(-v_rows, -1)) - F.col("z"), "_ma": F.avg("z").over(w.rowsBetween(1, v_rows)) - F.col("z"),
            "_fs": F.collect_list("frame").over(wide), "_zs": F.collect_list("z").over(wide),
            "_dense": F.count("*").over(plain.rangeBetween(-20, 20)),
            "_a": F.lag(p, 3).over(plain), "_b": F.lead(p, 3).over(plain)})
        return t

    t = in_segments(points, KEYS, gap, max(min_before, min_after, 20), build)
    a, b = F.col("_a"), F.col("_b")
    speed = hypot(*[b[c] - a[c] for c in "xyz"]) / ((b["frame"] - a["frame"]) / FPS)
    t = t.where(
        (F.col("_before") >= min_before) & (F.col("_after") >= min_after) & (F.col("z") <= z_max)
        & (F.abs("x") <= COURT.half_width + 1) & (F.abs("y") <= COURT.half_length + 1)
        & (F.col("_dense") >= dense) & (speed >= min_speed))
    lo, hi = F.least("_mb", "_ma"), F.greatest("_mb", "_ma")
    t = t.where((lo >= 0.05) & (hi >= 0.10))  # no rule accepts a row below the moderate V

    def ratio(f: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(_split_ratio(f, z, halves), dtype="float64")

    ratio = F.pandas_udf(ratio, "double", F.PandasUDFType.SCALAR)
    t = t.withColumn("ratio", ratio("_fs", "_zs"))
    ok = ((lo >= 0.10) & (hi >= 0.20)) | (F.col("ratio") >= 5.0) | ((F.col("ratio") >= 2.0) & (F.col("z") < 0.4))
    return t.where(ok).withColumn("v_score", F.col("_mb") + F.col("_ma")).select(*KEYS, "frame", "t", "x", "y", "z", "v_score", "ratio")


def hybrid_bounces(points: DataFrame) -> DataFrame:
    """Whole-recording detector: candidates nearer than five frames keep the best score."""
    from .motion import keep_last_better

    c = hybrid_signals(points, 4, (3, 4, 6), 1.5, 3, 20, 3.0, 6, 6)
    return keep_last_better(c, 5, F.col("v_score") + 0.1 * F.col("ratio"), "x double, y double, z double")


def hybrid_bounces_live(points: DataFrame, cooldown: int = 12) -> DataFrame:
    """Online detector: wider V, first one wins until the cooldown has passed, landing moved to
    the lowest row within four rows."""
    from .smooth import in_segments

    c = first_wins(hybrid_signals(points, 8, (4, 6, 8), 0.8, 5, 17, 3.0, 8, 8), KEYS, cooldown)
    low = in_segments(points, KEYS, 5, 4, lambda t, w: t.withColumn("_low", F.min(F.struct("z", "frame", "x", "y")).over(w.rowsBetween(-4, 4))))
    j = c.select(*KEYS, "frame", "v_score", "ratio").join(low.select(*KEYS, "frame", "_low"), [*KEYS, "frame"])
    conf = F.bround(F.least(F.lit(1.0), F.col("v_score") + 0.1 * F.col("ratio")), 3)
    return j.select(*KEYS, "frame", F.col("_low.frame").alias("land_frame"), *[F.col(f"_low.{c}").alias(c) for c in "xyz"], conf.alias("confidence"))


def pixel_bounces(det: DataFrame, points: DataFrame, window: int = 8, min_margin: float = 20.0, min_py: float = 200.0, gap: int = 3,
                  slope: float = 8.0, dense: int = 15, min_speed: float = 5.0, min_range: float = 80.0, min_gap: int = 20) -> DataFrame:
    """Landings as image-height maxima of the camera facing that half, checked against flight.

    ``det`` holds both cameras; each is smoothed by a five-row median over its whole series.
    """
    from ..court import COURT
    from ..functions.geometry import hypot
    from .joins import band_join
    from .motion import keep_last_better
    from .ordered import BLK, local_segments, row_index
    from .smooth import median

    cam = ["session_id", "camera"]

    def wide(t: DataFrame, w: WindowSpec) -> DataFrame:
        p = F.struct("frame", "pixel_x", "pixel_y")
        v = w.rowsBetween(-10, 10)
        t = t.withColumns({
            "ps": median(F.collect_list("pixel_y").over(w.rowsBetween(-2, 2))),
            "_a": F.first(p).over(w.rowsBetween(-5, 0)), "_b": F.last(p).over(w.rowsBetween(0, 5)),
            "_range": F.max("pixel_y").over(v) - F.min("pixel_y").over(v)})
        t = t.withColumn("_brk", F.coalesce(F.col("frame") - F.lag("frame").over(w) > gap, F.lit(True)))
        t = t.withColumn("_seg", F.max(F.when(F.col("_brk"), F.col("frame"))).over(w))
        ws = Window.partitionBy(*cam, BLK, "_seg").orderBy("frame")
        side = lambda a, b: F.when(F.count("*").over(ws.rowsBetween(a, b)) == window, F.min("ps").over(ws.rowsBetween(a, b)))
        return t.withColumns({
            "ml": F.col("ps") - side(-window, -1), "mr": F.col("ps") - side(1, window),
            "_peak": F.col("ps") >= F.max("ps").over(ws.rowsBetween(-3, 3)) - 1.0,
            "_dn": F.col("ps") - F.lag("ps", 4).over(ws) > slope, "_up": F.col("ps") - F.lead("ps", 4).over(ws) > slope})

    t = windowed(row_index(det, cam, "frame"), cam, "idx", wide, 2 * window + 4, 2 * window + 4)
    strong, weak = F.greatest("ml", "mr"), F.least("ml", "mr")
    a, b = F.col("_a"), F.col("_b")
    speed = hypot(b["pixel_x"] - a["pixel_x"], b["pixel_y"] - a["pixel_y"]) / (b["frame"] - a["frame"])
    own = F.when(F.col("camera") == "cam66", F.col("world_y") <= 2.0).otherwise(F.col("world_y") >= -2.0)
    c = t.where((F.col("ps") >= min_py) & (weak > 0) & (strong >= min_margin) & (weak >= min_margin / 2) & F.col("_peak") & F.col("_dn") & F.col("_up")
                & own & (speed >= min_speed) & (F.col("_range") >= min_range))
    frames = det.select("session_id", "frame").distinct()
    near = band_join(c.select("session_id", "frame").distinct(), frames.select("session_id", F.col("frame").alias("_f")), KEYS, "frame", "_f", 20, 20)
    busy = near.groupBy("session_id", "frame").agg(F.count("*").alias("_n")).where(F.col("_n") >= dense)
    prior = band_join(c.select("session_id", "frame").distinct(), points.select("session_id", F.col("frame").alias("_f"), F.col("z").alias("_z")), KEYS, "frame", "_f", 12, -1)
    zs = F.array_sort(F.collect_list(F.struct("_f", "_z")))
    flew = prior.groupBy("session_id", "frame").agg(zs.alias("_zs"), F.max("_z").alias("_mz")).where(
        (F.size("_zs") >= 3) & (F.col("_mz") >= 0.5) & (F.element_at("_zs", -1)["_z"] < F.element_at("_zs", -3)["_z"]))
    key = ["session_id", "frame"]
    c = c.join(busy.select(*key), key, "left_semi").join(flew.select(*key), key, "left_semi")
    c = c.withColumn("score", F.col("ml") + F.col("mr"))
    # both cameras may report one frame: the earlier listed camera is met first, a better one replaces it
    c = c.groupBy(*key).agg(F.max_by(F.struct("camera", "world_x", "world_y", "pixel_y", "score"), F.struct("score", F.col("camera") == "cam66")).alias("r")).select(*key, "r.*")
    return keep_last_better(c, min_gap, F.col("score"), "camera string, world_x double, world_y double, pixel_y double, score double")


def refine_by_pixels(bounces: DataFrame, det: DataFrame, radius: int = 2, better: float = 3.0) -> DataFrame:
    """Move a landing to a clearly lower image row nearby, in the camera facing its half.

    Offsets are tried in order and each accepted one must beat the best so far by ``better``.
    """
    from .joins import band_join

    cam = F.when(F.col("y") < 0, "cam66").otherwise("cam68")
    b = bounces.select("session_id", "frame", "x", "y", "z").withColumn("camera", cam)
    d = det.select("session_id", "camera", F.col("frame").alias("_f"), "pixel_y", "world_x", "world_y")
    near = band_join(b, d, ["session_id", "camera"], "frame", "_f", radius, radius)
    opts = near.groupBy("session_id", "camera", "frame").agg(F.array_sort(F.collect_list(F.struct("_f", "pixel_y", "world_x", "world_y"))).alias("o"))
    j = b.join(opts, ["session_id", "camera", "frame"], "left")
    own = F.filter("o", lambda s: s["_f"] == F.col("frame"))
    none = F.struct(F.col("frame").alias("_f"), F.lit(-1.0).alias("pixel_y"), F.lit(None).cast("double").alias("world_x"), F.lit(None).cast("double").alias("world_y"))
    start = F.coalesce(F.get(own, F.lit(0)), none)
    pick = F.aggregate(F.coalesce("o", F.array()), start, lambda acc, s: F.when((s["_f"] != F.col("frame")) & (s["pixel_y"] > acc["pixel_y"] + better), s).otherwise(acc))
    j = j.withColumn("p", pick)
    return j.select("session_id", F.col("frame").alias("frame_3d"), F.col("p._f").alias("frame"), "camera",
                    F.coalesce("p.world_x", "x").alias("x"), F.coalesce("p.world_y", "y").alias("y"), "z")


def merge_with_pixels(b3: DataFrame, b2: DataFrame, window: int = 8, min_score: float = 200.0) -> DataFrame:
    """All 3-D landings plus strong image landings with no 3-D one within ``window`` frames."""
    from .joins import band_join

    alone = band_join(b2.where(F.col("score") >= min_score), b3.select("session_id", F.col("frame").alias("_f")), KEYS, "frame", "_f", window, window, "left_anti")
    return b3.select("session_id", "frame", F.lit("3d").alias("origin")).unionByName(alone.select("session_id", "frame", F.lit("2d").alias("origin")))
