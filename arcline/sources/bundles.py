"""Bundles of tables, camera and truth files, documents and tracks for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.ordered import segments


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera matrices from JSON lines: camera, H_image_to_world, H_world_to_image, position_3d."""
    m = "array<array<double>>"
    t = spark.read.schema(f"camera string, H_image_to_world {m}, H_world_to_image {m}, position_3d array<double>").json(path)
    cols = [F.col(src)[i][j].alias(f"{n}{i}{j}") for n, src in (("h", "H_image_to_world"), ("g", "H_world_to_image")) for i in range(3) for j in range(3)]
    return t.select("camera", *cols, *[F.col("position_3d")[i].alias(f"pos_{c}") for i, c in enumerate("xyz")])


def camera_documents(cams: DataFrame) -> DataFrame:
    mat = lambda n: F.array(*[F.array(*[F.col(f"{n}{i}{j}") for j in range(3)]) for i in range(3)])
    return cams.select("camera", mat("h").alias("H_image_to_world"), mat("g").alias("H_world_to_image"), F.array("pos_x", "pos_y", "pos_z").alias("position_3d"))


def explode_truth(docs: DataFrame) -> DataFrame:
    """Truth documents (``session_id, bounces array<struct>``) as rows."""
    return docs.select("session_id", F.explode("bounces").alias("b")).select("session_id", "b.*")


def explode_frame_map(docs: DataFrame, field: str) -> DataFrame:
    """Documents keyed by frame text (``{"12": {...}}``) as rows with a numeric frame."""
    return docs.select("session_id", F.explode(field).alias("k", "v")).select("session_id", F.col("k").cast("long").alias("frame"), "v.*")


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet table per member, partitioned by session."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/{name}")


def bundle_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit(name).alias("member"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def materialised(df: DataFrame, path: str) -> DataFrame:
    """Write an expensive stage once and read it back on later runs."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        df.write.parquet(path)
        return spark.read.parquet(path)


def since(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows at or after each camera's cursor; cameras without one return everything."""
    t = rows.join(cursors.select("camera", "cursor"), "camera", "left")
    return t.where(F.col("frame") >= F.coalesce("cursor", F.lit(0))).drop("cursor")


def split_tracks(det: DataFrame, gap: int = 5) -> DataFrame:
    """Track tables for annotation tools: a frame step of ``gap`` or more starts a new track."""
    return segments(det, ["session_id", "camera"], "frame", gap - 1, "track")


def track_documents(tracks: DataFrame, piece: int = 1024) -> DataFrame:
    """Tracks as nested points; long tracks continue in further parts, so no row grows without bound."""
    part = F.floor((F.col("frame") - F.col("track")) / piece).cast("long")
    p = F.array_sort(F.collect_list(F.struct("frame", "pixel_x", "pixel_y")))
    return tracks.withColumn("part", part).groupBy("session_id", "camera", "track", "part").agg(p.alias("points"))


def shape_documents(det: DataFrame, label: str = "ball") -> DataFrame:
    """One annotation document per frame."""
    shape = F.struct(F.lit(label).alias("label"), F.array(F.array("pixel_x", "pixel_y")).alias("points"), F.lit("point").alias("shape_type"), F.lit("").alias("description"))
    return det.select("session_id", "camera", "frame", F.to_json(F.struct(F.array(shape).alias("shapes"))).alias("document"))


def utc8(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds + 8 * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rally_documents(rallies: DataFrame, results: DataFrame) -> DataFrame:
    """Nested rally payloads. ``results`` rows belong to a rally, whose events are few."""
    e = results.groupBy("session_id", "rally").agg(F.array_sort(F.collect_list(F.struct("frame", "nx", "ny", "kind", "speed"))).alias("resultmatrix"))
    t = rallies.join(e, ["session_id", "rally"])
    doc = F.struct(utc8(F.col("start_t")).alias("startTime"), utc8(F.col("end_t")).alias("endTime"),
                   F.struct(F.struct(F.col("strokes").alias("totalShots")).alias("mete"), "resultmatrix").alias("content"))
    return t.select("session_id", "rally", F.size("resultmatrix").alias("n_events"), F.to_json(doc).alias("document"))


def report_documents(summary: DataFrame) -> DataFrame:
    cols = [c for c in summary.columns if c != "session_id"]
    return summary.select("session_id", F.to_json(F.struct(F.struct(*cols).alias("summary"))).alias("value"))


def report_catalogue(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Past reports with their summaries, newest name first when sorted by the caller."""
    t = spark.read.schema(f"session_id bigint, value string").parquet(path)
    return t.select("session_id", F.from_json("value", f"summary struct<{fields}>").alias("d")).select("session_id", "d.summary.*")


def assigned_seconds(text: Column) -> Column:
    """Seconds of the first ``hh:mm:ss`` in a text."""
    p = lambda i: F.regexp_extract(text, r"(\d{1,2}):(\d{2}):(\d{2})", i).cast("int")
    return F.when(text.rlike(r"\d{1,2}:\d{2}:\d{2}"), p(1) * 3600 + p(2) * 60 + p(3))
