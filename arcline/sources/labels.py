"""Annotation files and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = "shapes array<struct<label:string,score:double,points:array<array<double>>,description:string,shape_type:string>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per shape; the frame number is the file stem, the session its folder."""
    raw = spark.read.schema(f"{SHAPES}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.col("_metadata.file_path")
    t = raw.select(F.regexp_extract(name, r"([0-9]+)\.json$", 1).cast("long").alias("frame"), F.regexp_extract(name, r"session=([0-9]+)", 1).cast("long").alias("session_id"), "shapes")
    return explode_shapes(t)


def explode_shapes(frames: DataFrame) -> DataFrame:
    """``frames``: session_id, frame, shapes."""
    t = frames.select("session_id", "frame", F.posexplode("shapes").alias("pos", "s"))
    first = F.get(F.col("s.points"), F.lit(0))
    second = F.get(F.col("s.points"), F.lit(1))
    mid = (F.col("s.shape_type") == "rectangle") & second.isNotNull()
    at = lambda i: F.when(mid, (first[i] + second[i]) / 2).otherwise(first[i])
    return t.select("session_id", "frame", "pos", "s.label", "s.score", F.lower(F.coalesce("s.description", F.lit(""))).alias("description"),
                    first[0].alias("raw_x"), first[1].alias("raw_y"), at(0).alias("pixel_x"), at(1).alias("pixel_y"))


def first_shapes(shapes: DataFrame) -> DataFrame:
    """First point of the first shape of each frame."""
    return shapes.where("pos = 0").select("session_id", "frame", F.col("raw_x").alias("pixel_x"), F.col("raw_y").alias("pixel_y"))


def match_balls(shapes: DataFrame) -> DataFrame:
    """First tagged ball per frame with its event flags."""
    t = shapes.where(F.col("description").contains("match_ball") & F.col("pixel_x").isNotNull())
    tags = {e: F.col("description").contains(e).alias(f"is_{e}") for e in ("bounce", "serve", "shot")}
    pick = F.min_by(F.struct("pixel_x", "pixel_y", *tags.values()), "pos")
    return t.groupBy("session_id", "frame").agg(pick.alias("b")).select("session_id", "frame", "b.*")


def human_balls(shapes: DataFrame) -> DataFrame:
    """All points placed by a person: no model score."""
    return shapes.where("score IS NULL AND pixel_x IS NOT NULL").select("session_id", "frame", "pos", "pixel_x", "pixel_y")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Label rows from text lines ``match, header, value``: columns found by header words, else by
    place; the frame may be a number or a file name; rows that do not parse are dropped."""
    heads = F.transform(F.split(F.lower("header"), ","), lambda h: F.trim(h))
    cells = F.transform(F.split("value", ","), lambda v: F.trim(v))
    spot = lambda test: F.array_position(F.transform(F.col("_h"), test), True).cast("int")
    t = lines.withColumns({"_h": heads, "_c": cells})
    t = t.withColumns({"_f": spot(lambda h: h.contains("frame")), "_v": spot(lambda h: h.contains("vis")), "_x": spot(lambda h: h == "x"), "_y": spot(lambda h: h == "y")})
    named = (F.col("_f") > 0) & (F.col("_x") > 0) & (F.col("_y") > 0)
    cell = lambda c, place: F.get("_c", F.when(named, F.col(c) - 1).otherwise(F.lit(place - 1)))
    vis = F.when(named & (F.col("_v") == 0), F.lit("2")).otherwise(cell("_v", 2))
    stem = F.regexp_extract(cell("_f", 1), r"^([0-9]+)(\.[A-Za-z]+)?$", 1)
    t = t.select("match", stem.alias("_s"), vis.alias("_vv"), cell("_x", 3).alias("_xx"), cell("_y", 4).alias("_yy"))
    t = t.select("match", F.expr("try_cast(_s AS bigint)").alias("frame"), F.expr("CAST(try_cast(_vv AS double) AS int)").alias("visibility"),
                 F.expr("try_cast(_xx AS double)").alias("x"), F.expr("try_cast(_yy AS double)").alias("y"))
    return t.na.drop()


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files with their header; the header is one row per file."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("match"))
    is_head = F.lower("value").contains("frame") & ~F.col("value").rlike("^[0-9]")
    heads = t.where(is_head).groupBy("match").agg(F.first("value").alias("header"))
    return parse_label_lines(t.where(~is_head).join(heads, "match"))


def training_labels(frames: DataFrame, truth: DataFrame, hard: DataFrame, scale: tuple[float, float]) -> DataFrame:
    """Visibility 2 and scaled position on truth frames; hard negatives and unknown frames are 0."""
    key = ["session_id", "frame"]
    t = frames.join(truth.select(*key, "pixel_x", "pixel_y"), key, "left").join(hard.select(*key, F.lit(True).alias("_hard")), key, "left")
    seen = F.col("pixel_x").isNotNull()
    kind = F.when(seen, "truth").when(F.col("_hard"), "hard_negative").otherwise("negative")
    pos: list[Column] = [F.when(seen, F.bround(F.col(c) * s, 1)).otherwise(0.0).alias(n) for c, s, n in (("pixel_x", scale[0], "x"), ("pixel_y", scale[1], "y"))]
    return t.select(*key, F.when(seen, 2).otherwise(0).alias("visibility"), *pos, kind.alias("kind"))


def catalogue(files: DataFrame) -> DataFrame:
    """List sizes per annotation file; files that do not parse are flagged."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    doc = F.from_json("content", "matches array<struct<frame:bigint>>, rallies array<struct<frame:bigint>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    t = files.withColumn("d", doc)
    bad = F.col("d._bad").isNotNull() | F.col("d").isNull()
    return t.select("name", F.when(bad, 0).otherwise(size("d.matches")).alias("matches"), F.when(bad, 0).otherwise(size("d.rallies")).alias("rallies"), bad.alias("unreadable"))
