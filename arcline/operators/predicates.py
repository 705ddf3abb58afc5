"""Row-level filters, flags and normalisations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..court import COURT, CourtSpec
from ..functions.geometry import hypot, judge, side

# Speed gates in km/h and keypoint positions (right shoulder, right wrist).
BALL_SPEED = (50.0, 150.0)
KP_SHOULDER, KP_WRIST, KP_MIN_CONF = 6, 10, 0.3


def serve_box(x: Column, y: Column, server: Column, court: CourtSpec = COURT) -> Column:
    """True when a serve from ``server`` lands in the opposite service box."""
    far = (y > 0) & (y < court.service_line)
    near = (y < 0) & (y > -court.service_line)
    return (F.abs(x) <= court.half_width) & F.when(server == "near", far).when(server == "far", near).otherwise(F.lit(False))


def judge_landings(df: DataFrame) -> DataFrame:
    reason = judge(F.col("x"), F.col("y"))
    return df.withColumns({"reason": reason, "is_out": reason != "in", "side": side(F.col("y"))})


def agreeing_frames(tracking: DataFrame, max_conf: float = 150, min_conf: float = 15, max_dist: float = 8) -> DataFrame:
    """Keep frames both cameras saw with plausible confidence and nearby ground points."""
    a, b = F.col("cam66"), F.col("cam68")
    ca, cb = F.coalesce(a["conf"], F.lit(0.0)), F.coalesce(b["conf"], F.lit(0.0))
    ok = (
        a.isNotNull() & b.isNotNull() & (ca <= max_conf) & (cb <= max_conf)
        & ~((ca < min_conf) & (cb < min_conf))
        & (hypot(a["wx"] - b["wx"], a["wy"] - b["wy"]) <= max_dist)
    )
    pos = F.coalesce(F.col("smoothed"), F.col("raw"))
    return tracking.where(ok & pos.isNotNull()).select(
        "session_id", "frame", "ts", pos["x"].alias("x"), pos["y"].alias("y"), pos["z"].alias("z"),
        ca.alias("conf66"), cb.alias("conf68"))


def clean_conditions(min_conf: float = 3.0, margin: float = 5.0, court: CourtSpec = COURT) -> tuple[Column, Column]:
    conf = F.col("blob_sum") >= min_conf
    bounds = (F.abs("world_x") <= court.half_width + margin) & (F.abs("world_y") <= court.half_length + margin)
    return conf, bounds


def clean_counts(det: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many rows each cleaning stage leaves, in one pass."""
    conf, bounds = clean_conditions()
    return det.groupBy(*by).agg(
        F.count("*").alias("n_input"), F.count_if(conf).alias("after_confidence"),
        F.count_if(conf & bounds).alias("after_bounds"))


def in_flight(max_ray: float = 5.0, margin: float = 3.0, z_max: float = 6.0, half: tuple[float, float] | None = None, court: CourtSpec = COURT) -> Column:
    """A 3-D point that may be the ball in flight: near lines of sight, over the court and a margin, not too high.

    ``half``: half width and length in place of the court with its margin.
    """
    x, y = half or (court.half_width + margin, court.half_length + margin)
    return (F.col("ray_dist") <= max_ray) & (F.abs("x") <= x) & (F.abs("y") <= y) & (F.col("z") <= z_max)


def plausible_points(max_ray: float = 1.5, z: tuple[float, float] = (-0.5, 8.0)) -> Column:
    return (F.col("ray_dist") <= max_ray) & F.col("z").between(*z)


def reject_counts(points: DataFrame, by: Sequence[str]) -> DataFrame:
    ray = F.col("ray_dist") > 1.5
    z_ok = F.col("z").between(-0.5, 8.0)
    sane = (F.abs("x") <= 20) & (F.abs("y") <= 30) & (F.col("z") <= 10)
    return points.groupBy(*by).agg(
        F.count_if(ray).alias("rejected_ray"), F.count_if(~ray & ~z_ok).alias("rejected_physics"),
        F.count_if(~ray & z_ok).alias("kept"), F.count_if(sane).alias("sane"))


def _unit(v: Column, half: float) -> Column:
    return F.bround(F.least(F.greatest((v + half) / (2 * half), F.lit(0.0)), F.lit(1.0)), 4)


def norm_x(x: Column) -> Column:
    return _unit(x, COURT.half_width)


def norm_y(y: Column) -> Column:
    return _unit(y, COURT.half_length)


def clamp_speed(s: Column) -> Column:
    return F.bround(F.least(F.greatest(s, F.lit(BALL_SPEED[0])), F.lit(BALL_SPEED[1])), 1)


def hand_type(keypoints: Column) -> Column:
    """Backhand when the right shoulder is right of a confidently seen right wrist."""
    s, w = F.get(keypoints, F.lit(KP_SHOULDER)), F.get(keypoints, F.lit(KP_WRIST))
    seen = (F.get(s, F.lit(2)) >= KP_MIN_CONF) & (F.get(w, F.lit(2)) >= KP_MIN_CONF)
    return F.when(seen & (F.get(s, F.lit(0)) > F.get(w, F.lit(0))), "backhand").otherwise("forehand")


def baseline_zone(y: Column) -> Column:
    return (y < -COURT.baseline_zone) | (y > COURT.baseline_zone)


def own_half(camera: Column, y: Column, slack: float = 0.5) -> Column:
    """A camera only reports players of its own half, with a little slack over the net."""
    return F.when(camera == "cam66", y <= slack).otherwise(y >= -slack)


def display_coords(df: DataFrame, scale: float = 10.0) -> DataFrame:
    return df.withColumns({
        "sx": F.col("x") * scale, "sy": F.col("y") * scale, "sz": F.col("z") * scale,
        "dx": (F.col("x") + COURT.half_width) / (2 * COURT.half_width),
        "dy": 1 - (F.col("y") + COURT.half_length) / (2 * COURT.half_length)})


def frame_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(F.col("frame").between(start, end))


def bounce_height_gate(df: DataFrame, far_z: float = 0.65, near_z: float = 0.35) -> DataFrame:
    """A bounce seen higher than this is a stroke; far landings are measured less exactly."""
    return df.where(F.col("z") <= F.when(F.col("y") > COURT.net_y, far_z).otherwise(near_z))


def multi_blob_frames(cands: DataFrame) -> DataFrame:
    return cands.groupBy("session_id", "camera", "frame").agg(F.count("*").alias("n_blobs")).where("n_blobs > 1")


def candidate_lists(cands: DataFrame, *extra: str) -> DataFrame:
    """One row per frame with its ranked candidates (a handful per frame by construction)."""
    cols = ["rank", "pixel_x", "pixel_y", "world_x", "world_y", "blob_sum", *extra]
    return cands.groupBy("session_id", "camera", "frame").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("cands"))


def rerank(frames: DataFrame, min_conf: float, conf: str = "vconf") -> DataFrame:
    """Best verified candidate by confidence times strength; the raw first one when none passes."""
    passed = F.filter("cands", lambda c: c[conf] >= min_conf)
    keyed = F.transform(passed, lambda c: F.struct((-c[conf] * c["blob_sum"]).alias("k"), c["rank"].alias("r"), c.alias("c")))
    best = F.array_min(keyed)["c"]
    return frames.withColumns({"best": F.coalesce(best, F.get("cands", F.lit(0))), "verified": best.isNotNull()})
