"""Speeds, direction changes, net crossings and cleaning of ordered positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..court import COURT, FPS
from ..functions.geometry import hypot
from ..session import cut_lineage
from .cooldown import last_better
from .ordered import BLK, gap_break, local_segments, neighbour, running, segments, upper_median, windowed
from .predicates import clean_conditions

KEYS = ["session_id"]
RALLY = ["session_id", "rally"]
# Speed gate (km/h) and calibration of the report.
SPEED_RAW = (25.0, 180.0)
SPEED_FACTOR = 0.8


def step_dist(w: WindowSpec, dims: str = "xyz") -> Column:
    return hypot(*[F.col(c) - F.lag(c).over(w) for c in dims])


def segment_rallies(
    points: DataFrame, max_gap_s: float = 1.0, jump_speed: float = 80.0, min_points: int = 15,
    min_seconds: float = 0.5, min_move: float = 2.0, fps: float = FPS,
) -> DataFrame:
    """Add ``rally`` (start frame): breaks at time gaps or impossible jumps, weak ones dropped."""

    def jump(w: WindowSpec) -> Column:
        dt = F.col("t") - F.lag("t").over(w)
        return (dt > max_gap_s) | ((dt > 0.2) & (step_dist(w) / dt > jump_speed))

    reach = math.ceil(max_gap_s * fps) + 1
    # segments are read twice (quality per rally, then the rows), so they are kept
    seg = cut_lineage(segments(points, KEYS, "frame", reach, "rally", jump))
    p = F.struct("t", "x", "y", "z")
    a, b = F.col("p0"), F.col("p1")
    strong = (
        seg.groupBy(*RALLY)
        .agg(F.count("*").alias("n"), F.min_by(p, "frame").alias("p0"), F.max_by(p, "frame").alias("p1"))
        .where((F.col("n") >= min_points) & (b["t"] - a["t"] >= min_seconds)
               & (hypot(*[b[c] - a[c] for c in "xyz"]) >= min_move))
        .select(*RALLY)
    )
    return seg.join(strong, RALLY, "left_semi")


def frame_speeds(rally_rows: DataFrame, max_row_gap: int = 26, ts: str = "t") -> DataFrame:
    """Calibrated km/h per row: 5-slot upper median of step speeds, gated to a plausible band.

    ``max_row_gap`` bounds the frame gap between neighbour rows of one rally.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        dt = F.col(ts) - F.lag(ts).over(w)
        raw = F.when((dt > 0) & (dt <= 0.5), step_dist(w) / dt * 3.6)
        t = t.withColumns({"_first": F.lag(ts).over(w).isNull(), "_v": raw})
        return t.withColumn("_med", upper_median(F.collect_list(F.struct("_v")).over(w.rowsBetween(-2, 2))["_v"]))

    med = windowed(rally_rows, RALLY, "frame", build, 3 * max_row_gap, 2 * max_row_gap)
    return med.where(~F.col("_first") & F.col("_med").between(*SPEED_RAW)).withColumn(
        "speed_kmh", F.col("_med") * SPEED_FACTOR).drop("_first", "_v", "_med")


def speed_profile(points: DataFrame, max_kmh: float = 300.0, max_gap: int = 5) -> DataFrame:
    """Speed between neighbour rows no further apart than ``max_gap`` frames."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        gap = F.col("frame") - F.lag("frame").over(w)
        return t.withColumn("speed_kmh", F.when(gap.between(1, max_gap), step_dist(w) / (gap / FPS) * 3.6))

    return windowed(points, KEYS, "frame", build, max_gap, 0).where(F.col("speed_kmh") < max_kmh)


def count_shots(rally_rows: DataFrame, max_row_gap: int = 26, min_move: float = 0.3) -> DataFrame:
    """Shots per rally: sign changes of the three-row move along the court."""
    moved = windowed(
        rally_rows, RALLY, "frame",
        lambda t, w: t.withColumn("_dy", F.col("y") - F.lag("y", 3).over(w)), 3 * max_row_gap, 0)
    signs = moved.where(F.abs("_dy") >= min_move).select(*RALLY, "frame", F.signum("_dy").alias("_s"))
    turned = neighbour(signs, RALLY, "frame", prev={"_last": (None, F.col("_s"))})
    n = turned.groupBy(*RALLY).agg(F.count_if(F.col("_s") != F.col("_last")).alias("shots"))
    return n


def clean_detections(det: DataFrame, max_speed: float = 80.0, max_gap: int = 10, fps: float = FPS,
                     margin: float = 5.0) -> DataFrame:
    """Confidence, court bounds, velocity against the previous bounded row, isolation.

    Bounded rows are at most one court diagonal apart, so past ``reach`` frames no step can be
    too fast and the look-back is finite.
    """
    conf, bounds = clean_conditions(margin=margin)
    diagonal = 2 * math.hypot(COURT.half_width + margin, COURT.half_length + margin)
    reach = math.ceil(diagonal * fps / max_speed) + 1
    keys = ["session_id", "camera"]

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        gap = F.col("frame") - F.lag("frame").over(w)
        slow = step_dist_world(w) / gap <= max_speed / fps
        kept = t.withColumn("_ok", gap.isNull() | (gap <= 0) | slow).where("_ok")
        near = lambda c: F.coalesce(F.abs(c - F.col("frame")) <= max_gap, F.lit(False))
        return kept.withColumn("_ok", near(F.lag("frame").over(w)) | near(F.lead("frame").over(w))).where("_ok").drop("_ok")

    return windowed(det.where(conf & bounds), keys, "frame", build, reach + max_gap, max_gap)


def step_dist_world(w: WindowSpec) -> Column:
    return hypot(F.col("world_x") - F.lag("world_x").over(w), F.col("world_y") - F.lag("world_y").over(w))


def crossed(prev: Column, cur: Column, net: float = COURT.net_y) -> Column:
    return ((prev < net) & (cur >= net)) | ((prev >= net) & (cur < net))


def net_crossings(points: DataFrame, fps: float = FPS, side_rows: int = 3, verify: int = 8, span: int = 4,
                  speed: tuple[float, float] = (20.0, 250.0), min_gap: int = 10, target: float = 100.0) -> DataFrame:
    """Verified crossings with the speed over a few frames around; close ones keep the likelier.

    The step may follow a gap of any length, but a crossing needs ``side_rows`` rows within
    ``verify`` frames before it, so the previous row is never further back than that.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        ends = w.rangeBetween(-span, span)
        p = F.struct("frame", "x", "y", "z")
        t = t.withColumns({
            "_py": F.lag("y").over(w),
            "_before": F.count("*").over(w.rangeBetween(-verify, -1)),
            "_after": F.count("*").over(w.rangeBetween(1, verify)),
            "_n": F.count("*").over(ends), "_a": F.first(p).over(ends), "_b": F.last(p).over(ends)})
        return t

    t = windowed(points, KEYS, "frame", build, verify + 1, verify + 1)
    a, b = F.col("_a"), F.col("_b")
    dt = (b["frame"] - a["frame"]) / fps
    cand = t.where(
        (((F.col("_py") < 0) & (F.col("y") >= 0)) | ((F.col("y") < 0) & (F.col("_py") >= 0)))
        & (F.col("_before") >= side_rows) & (F.col("_after") >= side_rows) & (F.col("_n") >= 3) & (dt > 1e-6)
    ).withColumns({
        "speed_kmh": hypot(*[b[c] - a[c] for c in "xyz"]) / dt * 3.6,
        "direction": F.when(F.col("y") > F.col("_py"), "near_to_far").otherwise("far_to_near")})
    cand = cand.where(F.col("speed_kmh").between(*speed)).select(*KEYS, "frame", "speed_kmh", "direction")
    return keep_last_better(cand, min_gap, -F.abs(F.col("speed_kmh") - target), "speed_kmh double, direction string")


def keep_last_better(cand: DataFrame, min_gap: int, score: Column, schema: str, keys: list[str] | None = None) -> DataFrame:
    """Sequential suppression: a row closer than ``min_gap`` to the last kept one replaces it only with a higher score."""
    keys = keys or KEYS
    cols = [f.split()[0] for f in schema.split(", ")]
    return last_better(cand.select(*keys, "frame", *cols, score.cast("double").alias("rank_score")), keys, min_gap, F.col("rank_score")).select(*keys, "frame", *cols)


def crossings_twopoint(points: DataFrame, max_gap: int = 5, fps: float = FPS) -> DataFrame:
    """Reference crossing speed from the two rows around the net."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        gap = F.col("frame") - F.lag("frame").over(w)
        hit = crossed(F.lag("y").over(w), F.col("y")) & (gap <= max_gap)
        return t.withColumns({"speed_kmh": F.when(hit, step_dist(w) / (gap / fps) * 3.6)})

    return windowed(points, KEYS, "frame", build, max_gap, 0).where(F.col("speed_kmh").isNotNull())


def crossing_counts(points: DataFrame, max_gap: int = 3, net: float = 0.0) -> DataFrame:
    """Strict side changes between rows at most ``max_gap`` frames apart."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        py, gap = F.lag("y").over(w), F.col("frame") - F.lag("frame").over(w)
        return t.withColumn("_hit", (gap <= max_gap) & (((py < net) & (F.col("y") > net)) | ((py > net) & (F.col("y") < net))))

    t = windowed(points, KEYS, "frame", build, max_gap, 0)
    return t.groupBy(*KEYS).agg(F.count_if(F.col("_hit")).alias("crossings"))


def block_consistency(det: DataFrame, size: int = 8, min_rows: int = 4, jump: float = 120.0) -> DataFrame:
    """Keep fixed frame blocks with enough rows and mostly smooth steps (blocks bound the window)."""
    part = ["session_id", "camera", "_b"]
    w = Window.partitionBy(*part).orderBy("frame")
    allw = Window.partitionBy(*part)
    gap = F.col("frame") - F.lag("frame").over(w)
    d = hypot(F.col("pixel_x") - F.lag("pixel_x").over(w), F.col("pixel_y") - F.lag("pixel_y").over(w))
    t = det.withColumn("_b", F.floor(F.col("frame") / size)).withColumn("_smooth", d < jump * gap)
    t = t.withColumns({"_n": F.count("*").over(allw), "_s": F.count_if(F.col("_smooth")).over(allw)})
    need = F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / 2))
    return t.where((F.col("_n") >= min_rows) & (F.col("_s") >= need)).drop("_b", "_smooth", "_n", "_s")


def resample(rows: DataFrame, ratio: int, is_event: Column) -> DataFrame:
    """One row per bucket of ``ratio`` frames, event rows first."""
    cols = [c for c in rows.columns if c != "session_id"]
    pick = F.min_by(F.struct(*cols), F.struct(F.when(is_event, 0).otherwise(1), F.col("frame")))
    return rows.groupBy("session_id", F.floor(F.col("frame") / ratio).alias("bucket")).agg(pick.alias("r")).select(
        "session_id", "bucket", "r.*")


def flight_mask(frames: DataFrame, good: DataFrame, coast: int = 5) -> DataFrame:
    """Frames in flight: good ones, frames seen within ``coast`` after one, and short gaps between good ones.

    ``frames``: all frames any camera saw; ``good``: frames whose 3-D point is plausible.
    """
    t = frames.join(good.select("session_id", "frame", F.lit(True).alias("_ok")), ["session_id", "frame"], "left")

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        return t.withColumn("_pg", F.max(F.when(F.col("_ok"), F.col("frame"))).over(w.rangeBetween(-coast, -1)))

    t = windowed(t, KEYS, "frame", build, coast, 0)
    ok = F.coalesce("_ok", F.lit(False))
    start = F.when(ok & F.col("_pg").isNotNull(), F.col("_pg") + 1).otherwise(F.col("frame"))
    t = t.where(ok | F.col("_pg").isNotNull())
    return t.select("session_id", F.explode(F.sequence(start, F.col("frame"))).alias("frame")).distinct()
