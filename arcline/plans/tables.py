"""Features, labels, sources, sinks, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import joins as J
from ..operators import motion as M
from ..operators import predicates as P
from ..operators import report as RP
from ..operators.ordered import row_index, segments, windowed
from ..session import cut_lineage, shared_folder
from ..sources import bundles as BU
from ..sources import labels as LA
from ..sources import logs as LO
from .evaluation import rounded
from .fixtures import table
from .motion import rallies
from .registry import query, r

KEYS = ["session_id"]


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spans(spark, sf):
    return table(spark, sf, "points").groupBy(*KEYS).agg(F.max("frame").alias("last"))


DENSE = "sp AS (SELECT session_id, UNNEST(RANGE(0, MAX(frame) + 1)) AS frame FROM points GROUP BY session_id)"


@query("s7_dense_labels", f"WITH {DENSE} SELECT sp.session_id, sp.frame, CASE WHEN g.frame IS NULL THEN 0 ELSE 1 END AS label FROM sp LEFT JOIN gt_px g ON g.session_id = sp.session_id AND g.frame = sp.frame")
def _(spark, sf):
    return FE.frame_labels(table(spark, sf, "gt_px"), FE.dense_frames(spans(spark, sf)))


def features(spark, sf, labels=None):
    a = table(spark, sf, "det66").select("session_id", "frame", "pixel_x", "pixel_y", "blob_sum", (F.col("blob_sum") / 4).alias("blob_max"),
                                         (F.col("event_id") % 7 + 10).alias("blob_area"), F.lit(3).alias("n_blobs"))
    return FE.rally_features(a, table(spark, sf, "det68"), spans(spark, sf), labels)


@query("w49_rally_features", f"""WITH {DENSE},
d AS (SELECT sp.session_id, sp.frame, a.pixel_x AS x, a.pixel_y AS y, CASE WHEN a.frame IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN b.frame IS NULL THEN 0 ELSE 1 END AS h2, a.blob_sum AS bs FROM sp LEFT JOIN det66 a ON a.session_id = sp.session_id AND a.frame = sp.frame LEFT JOIN det68 b ON b.session_id = sp.session_id AND b.frame = sp.frame),
e AS (SELECT *, COALESCE(SQRT(POW(x - LAG(x) OVER w, 2) + POW(y - LAG(y) OVER w, 2)), 0) AS vel, y - LAG(y) OVER w AS dy, MAX(CASE WHEN h = 1 THEN frame END) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd,
  MAX(CASE WHEN h = 0 THEN frame END) OVER (PARTITION BY session_id ORDER BY frame) AS p0, MIN(CASE WHEN h = 0 THEN frame END) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n0,
  MAX(CASE WHEN h = 1 THEN frame END) OVER (PARTITION BY session_id ORDER BY frame) AS ld, MIN(CASE WHEN h = 1 THEN frame END) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd, MAX(frame) OVER (PARTITION BY session_id) AS last
  FROM d WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
f AS (SELECT *, ABS(vel - COALESCE(LAG(vel) OVER w, 0)) AS accel, COALESCE(CASE WHEN dy * LAG(dy) OVER w < 0 THEN 1 ELSE 0 END, 0) AS fl FROM e WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
g AS (SELECT *, SUM(h) OVER w25 AS n25, COUNT(*) OVER w25 AS c25, SUM(h2) OVER w25 AS m25, AVG(bs) OVER w25 AS b25, AVG(vel) OVER w25 AS v25, STDDEV_POP(CASE WHEN h = 1 THEN vel END) OVER w25 AS sv25, SUM(h * h2) OVER w25 AS x25, MAX(y) OVER w25 - MIN(y) OVER w25 AS yr25, STDDEV_POP(x) OVER w25 AS sx25,
  SUM(fl) OVER w25 AS fl25, LIST(CASE WHEN h = 1 THEN frame END) FILTER (h = 1) OVER w25 AS l25, AVG(h) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS r50, SUM(h) OVER w100 AS n100, COUNT(*) OVER w100 AS c100 FROM f
  WINDOW w25 AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), w100 AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
i AS (SELECT *, LIST_TRANSFORM(RANGE(2, COALESCE(LEN(l25), 0) + 1), lambda k: CAST(l25[k] - l25[k - 1] AS DOUBLE)) AS iv FROM g)
SELECT session_id, frame, CASE WHEN h = 1 THEN 0 ELSE frame - COALESCE(ld, -999) END AS gap_before, CASE WHEN h = 1 THEN 0 ELSE COALESCE(nd, last + 1000) - frame END AS gap_after, CASE WHEN h = 1 THEN frame - COALESCE(p0, -1) ELSE 0 END AS run_length,
  CASE WHEN h = 1 THEN COALESCE(n0, last + 1) - COALESCE(p0, -1) - 1 ELSE 0 END AS total_run, ROUND(vel, 5) AS vel, ROUND(accel, 5) AS accel, ROUND(n25 / c25, 5) AS density_25, ROUND(m25 / c25, 5) AS density68_25, ROUND(COALESCE(b25, 0), 7) AS mean_sum_25, ROUND(v25, 5) AS mean_vel_25,
  ROUND(CASE WHEN n25 > 1 THEN sv25 ELSE 0 END, 5) AS std_vel_25, ROUND(x25 / GREATEST(n25, 1), 5) AS xcam_25, ROUND(CASE WHEN n25 > 1 THEN yr25 ELSE 0 END, 5) AS y_range_25, ROUND(CASE WHEN n25 > 1 THEN sx25 ELSE 0 END, 5) AS std_x_25, fl25 AS flips_25,
  ROUND(CASE WHEN n25 > 1 THEN LIST_AVG(iv) ELSE 25 END, 5) AS mean_gap_25, ROUND(CASE WHEN n25 > 1 THEN LIST_STDDEV_POP(iv) ELSE 25 END, 4) AS regularity_25, CASE WHEN n25 > 1 THEN LIST_MAX(iv) ELSE 25 END AS max_gap_25, ROUND(r50, 5) AS rate_50, ROUND(n100 / c100, 5) AS density_100 FROM i""")
def _(spark, sf):
    t = features(spark, sf)
    t = rounded(t, "vel", "accel", "density_25", "density68_25", "mean_vel_25", "std_vel_25", "xcam_25", "y_range_25", "std_x_25", "mean_gap_25", "rate_50", "density_100")
    t = rounded(t, "mean_sum_25", n=7)
    return t.select("session_id", "frame", "gap_before", "gap_after", "run_length", "total_run", "vel", "accel", "density_25", "density68_25", "mean_sum_25", "mean_vel_25", "std_vel_25", "xcam_25",
                    "y_range_25", "std_x_25", "flips_25", "mean_gap_25", r("regularity_25", 4).alias("regularity_25"), "max_gap_25", "rate_50", "density_100")


@query("w49_all_features")
def _(spark, sf):
    return features(spark, sf)


@query("w50_smooth_labels", f"""WITH {DENSE},
a AS (SELECT sp.session_id, sp.frame, CASE WHEN g.frame IS NULL THEN 0 ELSE 1 END AS v FROM sp LEFT JOIN gt_px g ON g.session_id = sp.session_id AND g.frame = sp.frame),
b AS (SELECT *, CASE WHEN v = LAG(v) OVER w THEN 0 ELSE 1 END AS c FROM a WINDOW w AS (PARTITION BY session_id ORDER BY frame)), d AS (SELECT *, SUM(c) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM b),
e AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id, g) AS n, g = 1 OR g = MAX(g) OVER (PARTITION BY session_id) AS edge FROM d), f AS (SELECT session_id, frame, CASE WHEN v = 0 AND NOT edge AND n < 3 THEN 1 ELSE v END AS v FROM e),
b2 AS (SELECT *, CASE WHEN v = LAG(v) OVER w THEN 0 ELSE 1 END AS c FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame)), d2 AS (SELECT *, SUM(c) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM b2),
e2 AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id, g) AS n FROM d2) SELECT session_id, frame, CASE WHEN v = 1 AND n < 5 THEN 0 ELSE v END AS label FROM e2""")
def _(spark, sf):
    return FE.smooth_labels(FE.frame_labels(table(spark, sf, "gt_px"), FE.dense_frames(spans(spark, sf))), min_gap=3)


@query("l1_l2_rally_model")
def _(spark, sf):
    labels = FE.frame_labels(table(spark, sf, "gt_px"), FE.dense_frames(spans(spark, sf)))
    path = scratch(spark, "features")
    # only what the models read, in columns: a few small numbers in each
    features(spark, sf, labels).select("session_id", "frame", "label", *FE.FEATURES).write.parquet(path)
    f = spark.read.parquet(path)
    prob = cut_lineage(FE.rally_probability(FE.train_rally_models(f, trees=10, depth=4), f))
    return FE.predicted_rallies(prob).groupBy("session_id").agg(F.count_if(F.col("rally") == 1).alias("rally_frames"), r(F.avg(((F.col("prob") >= 0.42).cast("int") == F.col("label")).cast("double"))).alias("accuracy"))


@query("w51_training_windows")
def _(spark, sf):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cam = lambda t, n: table(spark, sf, t).select("session_id", "frame", F.col("pixel_x").alias(f"{n}_x"), F.col("pixel_y").alias(f"{n}_y"))
    p = table(spark, sf, "points").select("session_id", "frame", "event_type").join(cam("det66", "a"), ["session_id", "frame"], "left").join(cam("det68", "b"), ["session_id", "frame"], "left")
    rows = row_index(p.withColumns({f"{n}_{v}": z(F.col(f"{n}_{v}")) for n in "ab" for v in "xy"}), KEYS, "frame")
    w = FE.balance_classes(FE.training_windows(rows, "event_type"), "label", "view", 2)
    return w.select("session_id", "frame", "label", "copy", F.size("window").alias("rows"), r(F.col("window")[12][12]).alias("speed"))


@query("w54_hit_flags", """
WITH a AS (SELECT *, CASE WHEN frame - LAG(frame) OVER w <= 5 THEN SQRT(POW(x-LAG(x) OVER w,2)+POW(y-LAG(y) OVER w,2)+POW(z-LAG(z) OVER w,2)) / ((frame - LAG(frame) OVER w)/25.0) * 3.6 END AS v FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
b AS (SELECT *, v - LAG(v) OVER w AS dv, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bt FROM a WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, frame, COALESCE(event_type <> 'purchase' AND t - bt < 1 AND dv > 0, FALSE) AS is_hit FROM b""")
def _(spark, sf):
    def build(t, w):
        gap = F.col("frame") - F.lag("frame").over(w)
        t = t.withColumn("_v", F.when(gap <= 5, M.step_dist(w) / (gap / 25.0) * 3.6))
        near = F.last(F.when(F.col("event_type") == "purchase", F.col("t")), ignorenulls=True).over(w.rowsBetween(-30, -1))
        return t.withColumns({"_dv": F.col("_v") - F.lag("_v").over(w), "_bt": near})

    # a landing counts for one second, so the look-back is bounded by that many frames
    t = windowed(table(spark, sf, "points"), KEYS, "frame", build, 32, 0)
    hit = (F.col("event_type") != "purchase") & (F.col("t") - F.col("_bt") < 1) & (F.col("_dv") > 0)
    return t.select("session_id", "frame", F.coalesce(hit, F.lit(False)).alias("is_hit"))


_FLIGHT = """
WITH g AS (SELECT session_id, frame FROM points WHERE {gate}),
d AS (SELECT DISTINCT session_id, frame FROM det),
a AS (SELECT d.*, g.frame IS NOT NULL AS ok, (SELECT MAX(q.frame) FROM g q WHERE q.session_id = d.session_id AND q.frame < d.frame AND EXISTS (SELECT 1 FROM d e WHERE e.session_id = q.session_id AND e.frame = q.frame)) AS pg FROM d LEFT JOIN g ON g.session_id = d.session_id AND g.frame = d.frame),
o AS (SELECT session_id, frame FROM a WHERE ok OR frame - pg <= 5 UNION SELECT session_id, UNNEST(RANGE(pg + 1, frame)) FROM a WHERE ok AND frame - pg <= 5) SELECT DISTINCT session_id, frame FROM o"""


@query("p9_flight_mask", _FLIGHT.format(gate="ray_dist <= 1.7 AND ABS(x) <= 4.115 + 3 AND ABS(y) <= 11.885 + 3 AND z <= 6"))
def _(spark, sf):
    p = table(spark, sf, "points").where(P.in_flight(max_ray=1.7))
    return M.flight_mask(table(spark, sf, "det").select("session_id", "frame").distinct(), p)


@query("p9_flight_mask_narrow", _FLIGHT.format(gate="ray_dist <= 5 AND ABS(x) <= 5 AND ABS(y) <= 9 AND z <= 1.2"))
def _(spark, sf):
    p = table(spark, sf, "points").where(P.in_flight(half=(5.0, 9.0), z_max=1.2))
    return M.flight_mask(table(spark, sf, "det").select("session_id", "frame").distinct(), p)


def tracking_frames(spark, sf):
    from .geometry import tracking_rows

    t = tracking_rows(spark, sf).withColumn("capture_ts", F.col("ts") - 0.01)
    b = table(spark, sf, "gt_events").select("session_id", "frame", F.struct("x", "y", "z", F.col("t").alias("timestamp"), F.lit(True).alias("in_court"), F.col("frame").alias("frame_index"), F.lit(1.0).alias("confidence")).alias("bounce"))
    return t.join(b, ["session_id", "frame"], "left")


@query("s1_s2_tracking_log", """SELECT p.session_id, p.frame, p.t AS ts, CASE WHEN p.event_type = 'purchase' THEN 'bounce' ELSE 'tracking' END AS state, ROUND(a.blob_sum, 2) AS conf66, MIN(p.t) OVER (PARTITION BY p.session_id) AS t0
FROM points p LEFT JOIN det66 a ON a.session_id = p.session_id AND a.frame = p.frame""")
def _(spark, sf):
    path = scratch(spark, "log")
    LO.write_log(LO.log_rows(tracking_frames(spark, sf)), path)
    rows = LO.ball_rows(LO.read_log(spark, path))
    return rows.join(LO.first_timestamps(rows), "session_id").select("session_id", "frame", "ts", "state", F.round("cam66.conf", 2).alias("conf66"), "t0")


@query("s3_pose_rows", "SELECT session_id, frame, ROUND(near_x, 4) AS foot_x FROM play WHERE near_x IS NOT NULL")
def _(spark, sf):
    path = scratch(spark, "poses")
    p = table(spark, sf, "play").where("near_x IS NOT NULL")
    player = F.struct(F.array(F.lit(0.0)).alias("bbox"), F.lit(0.9).alias("conf"), F.array("near_x", "near_y").alias("foot_court"), F.lit(-1.0).alias("dist_to_ball_2d"))
    LO.write_log(p.select("session_id", F.lit("player_pose").alias("type"), "ts", F.lit("cam66").alias("camera"), player.alias("player")), path)
    t = LO.pose_rows(LO.read_log(spark, path))
    return t.select("session_id", F.round(F.col("timestamp") * 25).cast("long").alias("frame"), r(F.col("player.foot_court")[0], 4).alias("foot_x"))


def annotation_frames(spark, sf):
    """Annotation documents per frame: a model shape, then a tagged human one."""
    shape = lambda *a: F.struct(*[x.alias(n) for x, n in zip(a, ("label", "score", "points", "description", "shape_type"))])
    xy = F.array("pixel_x", "pixel_y")
    box = F.array(F.array(F.col("pixel_x") - 5, F.col("pixel_y") - 5), F.array(F.col("pixel_x") + 5, F.col("pixel_y") + 5))
    model = shape(F.lit("ball"), F.lit(0.9), F.array(F.array(F.col("pixel_x") + 3, F.col("pixel_y"))), F.lit(None).cast("string"), F.lit("point"))
    human = shape(F.lit("ball"), F.lit(None).cast("double"), F.when(F.col("event_type") == "click", box).otherwise(F.array(xy)),
                  F.concat(F.lit("Match_Ball,"), F.when(F.col("event_type") == "purchase", "bounce").when(F.col("event_type") == "signup", "serve").otherwise("")),
                  F.when(F.col("event_type") == "click", "rectangle").otherwise("point"))
    return table(spark, sf, "gt_px").select("session_id", "frame", F.array(model, human).alias("shapes"))


@query("s4_first_shapes", "SELECT session_id, frame, ROUND(pixel_x + 3, 5) AS px FROM gt_px")
def _(spark, sf):
    return LA.first_shapes(LA.explode_shapes(annotation_frames(spark, sf))).select("session_id", "frame", r("pixel_x", 5).alias("px"))


@query("s5_match_balls", "SELECT session_id, frame, ROUND(pixel_x, 5) AS px, event_type = 'purchase' AS is_bounce, event_type = 'signup' AS is_serve, FALSE AS is_shot FROM gt_px")
def _(spark, sf):
    path = scratch(spark, "shapes")
    docs = annotation_frames(spark, sf)
    docs.select("session_id", "frame", F.to_json(F.struct("shapes")).alias("value")).write.parquet(path)
    back = spark.read.parquet(path).select("session_id", "frame", F.from_json("value", LA.SHAPES)["shapes"].alias("shapes"))
    return LA.match_balls(LA.explode_shapes(back)).select("session_id", "frame", r("pixel_x", 5).alias("px"), "is_bounce", "is_serve", "is_shot")


@query("s6_human_balls", "SELECT session_id, frame, ROUND(pixel_y, 5) AS py FROM gt_px")
def _(spark, sf):
    return LA.human_balls(LA.explode_shapes(annotation_frames(spark, sf))).select("session_id", "frame", r("pixel_y", 5).alias("py"))


@query("s8_label_lines", "SELECT CAST(session_id AS VARCHAR) AS match, frame, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS visibility, ROUND(pixel_x, 2) AS x FROM gt_px WHERE event_type <> 'signup'")
def _(spark, sf):
    g = table(spark, sf, "gt_px")
    name = F.when(F.col("event_type") == "purchase", F.concat("frame", F.lit(".png"))).when(F.col("event_type") == "signup", F.lit("broken")).otherwise(F.col("frame").cast("string"))
    line = F.concat_ws(",", name, F.when(F.col("event_type") == "click", F.lit("1.0")).otherwise(F.lit("2")), F.round("pixel_x", 2), F.round("pixel_y", 2))
    lines = g.select(F.col("session_id").cast("string").alias("match"), F.lit("Frame_No, Visibility ,X,Y").alias("header"), line.alias("value"))
    return LA.parse_label_lines(lines).select("match", "frame", "visibility", F.round("x", 2).alias("x"))


@query("s9_training_labels", "SELECT session_id, kind, COUNT(*) AS n FROM (SELECT p.session_id, CASE WHEN p.event_type IN ('click', 'purchase', 'signup') THEN 'truth' WHEN p.event_type = 'view' THEN 'hard_negative' ELSE 'negative' END AS kind FROM points p) GROUP BY session_id, kind")
def _(spark, sf):
    p = table(spark, sf, "points")
    t = LA.training_labels(p.select("session_id", "frame"), table(spark, sf, "gt_px"), p.where("event_type = 'view'"), (0.5, 0.5))
    return t.groupBy("session_id", "kind").agg(F.count("*").alias("n"))


@query("s10_camera_matrices", "SELECT d.session_id, d.camera, d.frame, ROUND(c.pos_y, 3) AS pos_y, ROUND(c.h00, 6) AS h00 FROM det d JOIN cams c ON c.camera = d.camera")
def _(spark, sf):
    path = scratch(spark, "cams")
    BU.camera_documents(table(spark, sf, "cams")).write.json(path)
    return table(spark, sf, "det").join(BU.read_cameras(spark, path), "camera").select("session_id", "camera", "frame", r("pos_y", 3).alias("pos_y"), r("h00").alias("h00"))


@query("s11_truth_documents", "SELECT session_id, frame, ROUND(x, 5) AS x FROM gt_events")
def _(spark, sf):
    g = table(spark, sf, "gt_events").withColumn("_part", F.floor(F.col("frame") / 1024))
    docs = g.groupBy("session_id", "_part").agg(F.collect_list(F.struct("frame", "x", "y", "z")).alias("bounces"))
    return BU.explode_truth(docs).select("session_id", "frame", r("x", 5).alias("x"))


@query("s12_frame_maps", "SELECT session_id, frame, ROUND(pixel_x, 5) AS px FROM det66")
def _(spark, sf):
    d = table(spark, sf, "det66").withColumn("_part", F.floor(F.col("frame") / 1024))
    entry = F.struct(F.col("frame").cast("string").alias("k"), F.struct(F.col("pixel_x").alias("px"), F.col("pixel_y").alias("py")).alias("v"))
    docs = d.groupBy("session_id", "_part").agg(F.map_from_entries(F.collect_list(entry)).alias("det66"))
    return BU.explode_frame_map(docs, "det66").select("session_id", "frame", r("px", 5).alias("px"))


@query("s13_s14_export_bundle", "SELECT session_id, 'points' AS member, COUNT(*) AS n FROM points GROUP BY 1 UNION ALL SELECT session_id, 'bounces', COUNT(*) FROM gt_events GROUP BY 1 UNION ALL SELECT session_id, 'detections', COUNT(*) FROM det GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "bundle")
    BU.write_bundle({"points": table(spark, sf, "points"), "bounces": table(spark, sf, "gt_events"), "detections": table(spark, sf, "det")}, path)
    return BU.bundle_counts({n: spark.read.parquet(f"{path}/{n}").withColumn("session_id", F.col("session_id").cast("long")) for n in ("points", "bounces", "detections")})


@query("s15_report_catalogue", "SELECT session_id, COUNT(*) AS n, ROUND(AVG(z), 4) AS mean_z FROM points GROUP BY session_id")
def _(spark, sf):
    path = scratch(spark, "reports")
    s = table(spark, sf, "points").groupBy("session_id").agg(F.count("*").alias("n"), r(F.avg("z"), 4).alias("mean_z"))
    BU.report_documents(s).write.parquet(path)
    return BU.report_catalogue(spark, path, "n:bigint,mean_z:double")


@query("s16_annotation_catalogue", "SELECT CAST(event_id AS VARCHAR) AS name, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS matches, 0 AS rallies, event_type = 'error' AS unreadable FROM points")
def _(spark, sf):
    p = table(spark, sf, "points")
    doc = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.to_json(F.struct(F.array(F.struct("frame"), F.struct((F.col("frame") + 1).alias("frame"))).alias("matches"))))
    return LA.catalogue(p.select(F.col("event_id").cast("string").alias("name"), doc.alias("content")))


@query("s17_since_cursor", "SELECT session_id, camera, frame FROM det WHERE frame >= CASE WHEN camera = 'cam66' THEN 400 ELSE 0 END")
def _(spark, sf):
    cur = table(spark, sf, "cams").where("camera = 'cam66'").select("camera", F.lit(400).alias("cursor"))
    return BU.since(table(spark, sf, "det"), cur).select("session_id", "camera", "frame")


@query("s18_camera_rows", "SELECT session_id, frame FROM det WHERE camera = 'cam68'")
def _(spark, sf):
    path = scratch(spark, "bycam")
    table(spark, sf, "det").select("session_id", "camera", "frame").write.partitionBy("camera").parquet(path)
    return spark.read.parquet(path).where("camera = 'cam68'").select("session_id", "frame").sortWithinPartitions("session_id", "frame")


@query("s21_stage_cache", "SELECT session_id, frame FROM gt_events")
def _(spark, sf):
    path = scratch(spark, "stage")
    d = table(spark, sf, "gt_events").select("session_id", "frame")
    BU.materialised(d, path)
    return BU.materialised(d, path)


@query("s22_split_tracks", """WITH a AS (SELECT *, CASE WHEN frame - LAG(frame) OVER w < 5 THEN 0 ELSE 1 END AS b FROM det WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id, camera ORDER BY frame) AS g FROM a) SELECT session_id, camera, MIN(frame) AS track, COUNT(*) AS n FROM s GROUP BY session_id, camera, g""")
def _(spark, sf):
    t = BU.track_documents(BU.split_tracks(table(spark, sf, "det")))
    return t.groupBy("session_id", "camera", "track").agg(F.sum(F.size("points")).alias("n"))


@query("s22_shape_documents", "SELECT session_id, camera, frame FROM det")
def _(spark, sf):
    return BU.shape_documents(table(spark, sf, "det")).where(F.length("document") > 2).select("session_id", "camera", "frame")


@query("s20_rally_documents")
def _(spark, sf):
    rows = rallies(spark, sf)
    key = ["session_id", "rally"]
    ra = rows.groupBy(*key).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("strokes"))
    m = RP.result_matrix(table(spark, sf, "play")).join(rows.select("session_id", "frame", "rally"), ["session_id", "frame"])
    return BU.rally_documents(ra, m)


@query("t1_top_candidates", "SELECT session_id, camera, frame, rank, ROUND(blob_sum, 5) AS blob_sum FROM cands QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, camera, frame ORDER BY blob_sum DESC, rank) <= 2")
def _(spark, sf):
    t = P.candidate_lists(table(spark, sf, "cands"))
    top = F.slice(F.array_sort("cands", lambda a, b: F.when(a["blob_sum"] > b["blob_sum"], -1).when(a["blob_sum"] < b["blob_sum"], 1).otherwise(a["rank"] - b["rank"])), 1, 2)
    return t.select("session_id", "camera", "frame", F.explode(top).alias("c")).select("session_id", "camera", "frame", "c.rank", r("c.blob_sum", 5).alias("blob_sum"))


@query("t7_match_split", """
WITH m AS (SELECT DISTINCT session_id FROM points WHERE session_id <> 0), v AS (SELECT session_id FROM m QUALIFY ROW_NUMBER() OVER (ORDER BY session_id * 48271 % 101, session_id) <= GREATEST(1, (SELECT COUNT(*) FROM m) * 20 // 100))
SELECT p.session_id, CASE WHEN v.session_id IS NULL THEN 'train' ELSE 'val' END AS part, COUNT(*) AS n FROM points p LEFT JOIN v ON v.session_id = p.session_id GROUP BY 1, 2""")
def _(spark, sf):
    t = FE.split_by_match(table(spark, sf, "points").select("session_id", "frame"), "session_id", F.col("session_id") == 0, order=F.col("session_id") * 48271 % 101)
    return t.groupBy("session_id", "part").agg(F.count("*").alias("n"))


@query("u1_common_frames", "SELECT a.session_id, a.frame FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame")
def _(spark, sf):
    return table(spark, sf, "det66").select("session_id", "frame").join(table(spark, sf, "det68").select("session_id", "frame"), ["session_id", "frame"], "left_semi")


@query("u2_frames_only_in_a", "SELECT session_id, frame FROM det66 EXCEPT SELECT session_id, frame FROM det68")
def _(spark, sf):
    return table(spark, sf, "det66").select("session_id", "frame").join(table(spark, sf, "det68"), ["session_id", "frame"], "left_anti")


@query("u3_all_frames", "SELECT session_id, frame FROM det66 UNION SELECT session_id, frame FROM det68")
def _(spark, sf):
    return table(spark, sf, "det66").select("session_id", "frame").unionByName(table(spark, sf, "det68").select("session_id", "frame")).distinct()


@query("u4_union_near_duplicates", """WITH e AS (SELECT * FROM det_events d WHERE NOT EXISTS (SELECT 1 FROM gt_events g WHERE g.session_id = d.session_id AND ABS(g.frame - d.frame) <= 2))
SELECT session_id, frame, 'a' AS origin FROM gt_events UNION ALL SELECT session_id, frame, 'b' FROM e""")
def _(spark, sf):
    g, d = table(spark, sf, "gt_events"), table(spark, sf, "det_events")
    e = J.band_join(d, g.select("session_id", F.col("frame").alias("gf")), KEYS, "frame", "gf", 2, 2, "left_anti")
    return g.select("session_id", "frame", F.lit("a").alias("origin")).unionByName(e.select("session_id", "frame", F.lit("b").alias("origin")))


@query("u5_concatenated_rallies", "WITH r AS (SELECT session_id, frame FROM points WHERE ray_dist <= 1.5) SELECT session_id, COUNT(*) AS n FROM (SELECT * FROM r UNION ALL SELECT session_id, frame FROM gt_events) GROUP BY session_id")
def _(spark, sf):
    a = table(spark, sf, "points").where("ray_dist <= 1.5").select("session_id", "frame")
    return a.unionByName(table(spark, sf, "gt_events").select("session_id", "frame")).groupBy("session_id").agg(F.count("*").alias("n"))
