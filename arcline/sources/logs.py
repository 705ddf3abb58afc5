"""Tracking logs: one JSON row per frame, poses in the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CAM = "struct<px:double,py:double,conf:double,wx:double,wy:double>"
_XYZ = "struct<x:double,y:double,z:double>"
TRACK_SCHEMA = (
    f"session_id bigint, type string, frame bigint, ts double, capture_ts double, cam66 {_CAM}, cam68 {_CAM}, `3d` {_XYZ}, smoothed {_XYZ}, "
    "bounce struct<x:double,y:double,z:double,timestamp:double,in_court:boolean,frame_index:bigint,confidence:double>, state string, camera string, "
    "player struct<bbox:array<double>,conf:double,foot_court:array<double>,dist_to_ball_2d:double,keypoints_px:array<array<double>>>")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACK_SCHEMA).json(path)


def ball_rows(log: DataFrame) -> DataFrame:
    """Ball rows only, shaped for the report filters."""
    return log.where(F.coalesce(F.col("type") != "player_pose", F.lit(True))).withColumnRenamed("3d", "raw").drop("type", "camera", "player")


def pose_rows(log: DataFrame) -> DataFrame:
    return log.where("type = 'player_pose'").select("session_id", "camera", F.col("ts").alias("timestamp"), "capture_ts", "player")


def first_timestamps(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.min_by("ts", "frame").alias("t0"))


def log_rows(frames: DataFrame) -> DataFrame:
    """Round and flag frames the way the log stores them.

    ``frames``: session_id, frame, ts, capture_ts, cam66, cam68, raw, smoothed, bounce (nullable structs).
    """
    def rounded(c: str, digits: dict[str, int]) -> Column:
        s = F.struct(*[F.bround(F.col(f"{c}.{n}"), d).alias(n) for n, d in digits.items()])
        return F.when(F.col(c).isNotNull(), s)

    cam = {"px": 1, "py": 1, "conf": 2, "wx": 3, "wy": 3}
    pos = {"x": 3, "y": 3, "z": 3}
    state = F.when(F.col("bounce").isNotNull(), "bounce").when(F.col("raw").isNull(), "no_match").otherwise("tracking")
    return frames.select(
        "session_id", "frame", F.bround("ts", 4).alias("ts"), F.bround("capture_ts", 4).alias("capture_ts"), rounded("cam66", cam).alias("cam66"),
        rounded("cam68", cam).alias("cam68"), rounded("raw", pos).alias("3d"), rounded("smoothed", pos).alias("smoothed"), "bounce", state.alias("state"))


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
