"""Streaming queries: the given event table is read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import triangulated
from ..operators import bounce as B
from ..operators import rally as R
from ..operators.fold import fold
from ..operators.joins import pair_frames
from ..operators.smooth import sg_matrix
from ..streaming import inorder as I
from ..streaming import live as L
from ..streaming import reports as RP
from ..streaming import rules as S
from ..streaming import tracker as TK
from .fixtures import _FROM, _T, CAM_A, CAM_B, table
from .geometry import _tri_sql
from .joins import FUSION_SQL, greedy_sql
from .registry import query, r

KEYS = ["session_id"]


def stream(spark, sf, name):
    """A derived view over the event table read as a file stream."""
    if name == "events":
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        # a pattern names the table whether it is one file or a folder of files; a plain path must be a folder
        return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    needs = {m.group(2) for m in _FROM.finditer(_T[name])}
    text = _FROM.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", _T[name])
    return spark.sql(text, **{n: stream(spark, sf, n) for n in needs})


def timed(df):
    """Sessions are laid one after another on the event-time axis, from a day after the epoch, as a row at the first watermark is late."""
    return df.withColumn("event_time", F.timestamp_micros(((F.col("session_id") * 10000 + F.col("t") + I.DAY) * 1000000).cast("long")))


@query("x1_stream_pairing", _tri_sql("SELECT session_id, frame, ROUND(x, 4) AS x, ROUND(z, 4) AS z FROM tri"))
def _(spark, sf):
    s = L.pair_streams(timed(stream(spark, sf, "det66")), timed(stream(spark, sf, "det68")), CAM_A, CAM_B)
    return L.run_to_table(s, "pairs").select("session_id", "frame", r("x", 4).alias("x"), r("z", 4).alias("z"))


@query("x6_stream_sessions", """
WITH a AS (SELECT *, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) < 25 THEN 0 ELSE 1 END AS b FROM points), s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM a)
SELECT session_id, MIN(frame) AS start_frame, MAX(frame) AS end_frame, COUNT(*) AS n FROM s GROUP BY session_id, g HAVING session_id * 10000 + MAX(t) + 1 <= (SELECT MAX(session_id * 10000 + t) - 5 FROM points)""")
def _(spark, sf):
    return L.run_to_table(L.activity_sessions(timed(stream(spark, sf, "points"))), "sessions")


_X4 = """
WITH RECURSIVE q AS (SELECT session_id, frame, t, x, y, z, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM points),
s AS (SELECT session_id, i, frame, t, x, y, z, CAST([] AS DOUBLE[]) AS v, CAST(NULL AS DOUBLE) AS was FROM q WHERE i = 1
  UNION ALL SELECT session_id, i, frame, t, x, y, z, CASE WHEN dt > 0.001 AND d / dt * 3.6 <= 280 THEN LIST_APPEND(v, d / dt * 3.6)[-5:] ELSE v END, was FROM (
    SELECT q.*, s.v, s.y AS was, q.t - s.t AS dt, SQRT((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z)) AS d FROM s JOIN q ON q.session_id = s.session_id AND q.i = s.i + 1) a)
SELECT session_id, frame, CAST(ROUND_EVEN(LIST_MEDIAN(v), 0) AS BIGINT) AS speed_kmh, CASE WHEN y > was THEN 'near_to_far' ELSE 'far_to_near' END AS direction FROM s
WHERE ((was < 0 AND y >= 0) OR (was > 0 AND y <= 0)) AND LEN(v) >= 2 AND LIST_MEDIAN(v) BETWEEN 30 AND 150"""


@query("x4_stream_crossings", _X4)
def _(spark, sf):
    t = I.drained(I.in_order(I.replayed(ball_rows(spark, sf), "t"), KEYS, S.motion()), "crossings").where("kind = 'crossing'")
    return t.select("session_id", "frame", F.col("speed").alias("speed_kmh"), "direction")


@query("x4_batch_crossings", _X4)
def _(spark, sf):
    p = table(spark, sf, "points").select("session_id", "frame", "t", "x", "y", "z")
    return fold(p, KEYS, "frame", L.CROSSING_STATE, L.crossing_step, L.CROSSING_SCHEMA)


_GATE = """
s AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST([] AS DOUBLE[]) AS q, CAST([] AS DOUBLE[]) AS h, CAST(0 AS DOUBLE) AS th, CAST(NULL AS DOUBLE) AS conf, FALSE AS ok FROM j GROUP BY session_id
  UNION ALL SELECT session_id, i, frame, CASE WHEN ok THEN quad ELSE q END, h, th, conf, ok FROM (SELECT *, NOT same AND conf >= th AS ok FROM (
    SELECT *, CASE WHEN NOT same AND LEN(h) >= 50 AND LEN(h) % 50 = 0 THEN LIST_SORT(h)[CAST(FLOOR(LEN(h) * 0.2) AS BIGINT) + 1] ELSE th0 END AS th FROM (
      SELECT j.session_id, j.i, j.frame, s.q, j.quad, j.conf, s.th AS th0, COALESCE(s.q = j.quad, FALSE) AS same, CASE WHEN COALESCE(s.q = j.quad, FALSE) THEN s.h ELSE LIST_APPEND(s.h, j.conf)[-500:] END AS h
      FROM s JOIN j ON j.session_id = s.session_id AND j.i = s.i + 1) t) u) v)
"""


@query("x2_x3_confidence_gate", f"""WITH RECURSIVE j AS (SELECT a.session_id, a.frame, [a.pixel_x, a.pixel_y, b.pixel_x, b.pixel_y] AS quad, (a.blob_sum + b.blob_sum) / 2 AS conf, ROW_NUMBER() OVER (PARTITION BY a.session_id ORDER BY a.frame) AS i
  FROM det66 a JOIN det68 b ON b.session_id = a.session_id AND b.frame = a.frame),{_GATE}SELECT session_id, frame, ROUND(conf, 6) AS conf, ROUND(th, 6) AS threshold FROM s WHERE ok""")
def _(spark, sf):
    j = pair_frames(table(spark, sf, "det66"), table(spark, sf, "det68"))
    t = fold(j, KEYS, "frame", L.GATE_STATE, L.gate_step, L.GATE_SCHEMA)
    return t.withColumns({c: r(c) for c in ("conf", "threshold")})


@query("x5_x7_stream_points_played")
def _(spark, sf):
    p = stream(spark, sf, "points")
    rows = p.select("session_id", "frame", "t", "y", "z", "ray_dist", *[F.when(F.col("event_type") == "purchase", c).alias(n) for c, n in (
        (F.col("x"), "b_x"), (F.col("y"), "b_y"), ((F.abs("x") <= 4.115) & (F.abs("y") <= 11.885), "b_in"))])
    t = L.stateful(rows, KEYS, "frame", R.point_state(), R.point_step, R.POINT_SCHEMA)
    return L.run_to_table(t, "rallies").select("session_id", "start_frame", "end_frame", "strokes", "bounces", "reason", "end_side", "server")


@query("x9_micro_batch_bounces", )
def _(spark, sf):
    p = stream(spark, sf, "points").select("session_id", "frame", "t", "x", "y", "z")
    return L.emit_unseen(p, "bounces", ["session_id", "frame"], B.peak_bounces).withColumns({c: r(c) for c in "xyz"})


@query("x12_closed_rally_rows", """
WITH c AS (SELECT p.*, LAG(y) OVER w AS py, CASE WHEN frame - LAG(frame) OVER w <= 75 THEN 0 ELSE 1 END AS b FROM points p WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g, COALESCE((py < 0 AND y >= 0) OR (py >= 0 AND y < 0), FALSE) AS cr FROM c),
f AS (SELECT session_id, g, frame, MIN(CASE WHEN cr THEN frame END) OVER (PARTITION BY session_id, g) AS st FROM s),
q AS (SELECT session_id, st, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY st) AS rally FROM f WHERE frame >= st GROUP BY session_id, st)
SELECT session_id, rally, n FROM q""")
def _(spark, sf):
    ra = R.crossing_rallies(table(spark, sf, "points"), table(spark, sf, "gt_events"))
    return L.closed_rallies_with_rows(ra, table(spark, sf, "play")).groupBy("session_id", "rally").agg(F.count("*").alias("n"))


# ---- rules in event-time order, over the table cut into files ---------------------------------

DETECTION = ("world_x", "world_y", "pixel_x", "pixel_y", "blob_sum")


def camera_rows(spark, sf):
    """Both cameras as one series; the second one captures 13 ms later."""
    late = F.when(F.col("camera") == "cam66", 0).otherwise(13)
    return table(spark, sf, "det").select("session_id", F.when(F.col("camera") == "cam66", "a").otherwise("b").alias("side"), "frame",
                                          ((F.col("frame") * 40 + late) / 1000).alias("t"), *DETECTION)


def ball_rows(spark, sf):
    """3-D points with what each camera saw of them."""
    p, d = table(spark, sf, "points").select("session_id", "frame", "t", "x", "y", "z"), table(spark, sf, "det")
    for side, cam in (("a", "cam66"), ("b", "cam68")):
        p = p.join(d.where(F.col("camera") == cam).select("session_id", "frame", F.col("world_x").alias(f"{side}_x"), F.col("world_y").alias(f"{side}_y"), F.col("blob_sum").alias(f"{side}_conf")),
                   ["session_id", "frame"], "left")
    return p


def rally_rows(spark, sf):
    e = table(spark, sf, "gt_events").select("session_id", "frame", F.lit(True).alias("bounce"))
    return table(spark, sf, "points").select("session_id", "frame", "t", "y").join(e, ["session_id", "frame"], "left")


_PAIRS = """SELECT session_id, tt AS driver_at, pick AS partner_at FROM g WHERE pick IS NOT NULL"""
_DRIVER, _PARTNER = "SELECT session_id, frame * 40 AS tt FROM det66", "SELECT session_id, frame * 40 + 13 AS tt FROM det68"


def live_pairs(spark, sf, files=4):
    return I.in_order(I.replayed(camera_rows(spark, sf), "t", files), KEYS, S.pairing(cols=DETECTION))


@query("x1_stream_nearest", greedy_sql(_DRIVER, _PARTNER, 2000, "nearest_unused", True, f"SELECT session_id, CAST(driver_at / 40 AS BIGINT) AS frame, CAST((partner_at - 13) / 40 AS BIGINT) AS b_frame FROM ({_PAIRS})"))
def _(spark, sf):
    return I.drained(live_pairs(spark, sf), "nearest").select("session_id", "frame", "b_frame")


@query("x2_x3_stream_gate", greedy_sql(_DRIVER, _PARTNER, 2000, "nearest_unused", True, f"""
, j AS (SELECT q.session_id, a.frame, [a.pixel_x, a.pixel_y, b.pixel_x, b.pixel_y] AS quad, (a.blob_sum + b.blob_sum) / 2 AS conf, ROW_NUMBER() OVER (PARTITION BY q.session_id ORDER BY a.frame) AS i
  FROM ({_PAIRS}) q JOIN det66 a ON a.session_id = q.session_id AND a.frame * 40 = driver_at JOIN det68 b ON b.session_id = q.session_id AND b.frame * 40 + 13 = partner_at),{_GATE}SELECT session_id, frame, ROUND(conf, 6) AS conf, ROUND(th, 6) AS threshold FROM s WHERE ok"""))
def _(spark, sf):
    t = I.drained(I.in_order(live_pairs(spark, sf), KEYS, S.gate(), None), "gated")
    return t.select("session_id", "frame", r("conf").alias("conf"), r("threshold").alias("threshold"))


_SG = [float(v) for v in sg_matrix(11, 3)[5]]


def _online(c):
    return " + ".join(f"{w!r} * LAG({c}, {10 - k}) OVER w" for k, w in enumerate(_SG))


@query("w53_online_smoothing", f"""
WITH c AS (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY session_id ORDER BY frame) <= 0.2 THEN 0 ELSE 1 END AS b FROM points),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM c),
f AS (SELECT session_id, frame AS at_frame, LAG(frame, 10) OVER w IS NOT NULL AS smooth, LAG(frame, 5) OVER w AS mid, x, y, z, {_online("x")} AS sx, {_online("y")} AS sy, {_online("z")} AS sz FROM s
  WINDOW w AS (PARTITION BY session_id, g ORDER BY frame))
SELECT session_id, at_frame, smooth, CASE WHEN smooth THEN mid ELSE at_frame END AS frame, ROUND(CASE WHEN smooth THEN sx ELSE x END, 6) AS x, ROUND(CASE WHEN smooth THEN sy ELSE y END, 6) AS y,
  ROUND(CASE WHEN smooth THEN GREATEST(sz, 0) ELSE z END, 6) AS z FROM f""")
def _(spark, sf):
    rows = table(spark, sf, "points").select("session_id", "frame", "t", "x", "y", "z")
    t = I.drained(I.in_order(I.replayed(rows, "t"), KEYS, S.smoothing()), "smooth")
    return t.select("session_id", "at_frame", "smooth", "frame", *[r(c).alias(c) for c in "xyz"])


def live_chain(stream, context_s=None):
    """Points with camera columns to crossings and judged landings: three stateful operators in one plan."""
    t = I.in_order(stream, KEYS, S.motion())
    t = I.in_order(t, KEYS, S.landings(), None)
    return I.in_order(t, KEYS, S.acceptance(context_s=context_s), None)


@query("x5_live_chain")
def _(spark, sf):
    t = I.drained(live_chain(I.replayed(ball_rows(spark, sf), "t")), "chain")
    return t.drop("event_time").withColumns({c: r(c) for c in ("t", "x", "y", "z", "confidence")})


_RALLIES_SQL = """c AS (SELECT p.*, LAG(y) OVER w AS py, CASE WHEN frame - LAG(frame) OVER w <= {pause} THEN 0 ELSE 1 END AS b FROM points p WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g, COALESCE((py < 0 AND y >= 0) OR (py >= 0 AND y < 0), FALSE) AS cr FROM c),
f AS (SELECT *, MIN(CASE WHEN cr THEN frame END) OVER (PARTITION BY session_id, g) AS st FROM s),
ra AS (SELECT f.session_id, ROW_NUMBER() OVER (PARTITION BY f.session_id ORDER BY st) AS rally, st AS start_frame, MAX(f.frame) AS end_frame, COUNT(*) FILTER (cr) AS strokes, COUNT(e.frame) AS bounces, MAX(f.t) - MIN(f.t) AS s
  FROM f LEFT JOIN gt_events e ON e.session_id = f.session_id AND e.frame = f.frame WHERE f.frame >= st GROUP BY f.session_id, st)"""


def live_rallies(spark, sf, files=4, timeout=3.0):
    return I.in_order(I.replayed(rally_rows(spark, sf), "t", files), KEYS, S.crossing_rallies(timeout))


@query("x6_stream_rallies", f"WITH {_RALLIES_SQL.format(pause=75)} SELECT session_id, rally, start_frame, end_frame, strokes, bounces FROM ra")
def _(spark, sf):
    return I.drained(live_rallies(spark, sf), "rallies").select("session_id", "rally", "start_frame", "end_frame", "strokes", "bounces")


def fusion_frames(stream, delay="1 second"):
    """One row a frame with both cameras' columns (null where a camera saw nothing) and the triangulated point.

    The frame's rows meet in an aggregation by frame and event time, closed by the watermark: a full outer join of any number of cameras.
    """
    seen = lambda side: F.first(F.when(F.col("side") == side, F.struct(F.col("world_x").alias("x"), F.col("world_y").alias("y"), F.col("pixel_y").alias("py"), F.col("blob_sum").alias("conf"))), ignorenulls=True).alias(side)
    g = stream.withWatermark(I.AT, delay).groupBy("session_id", "frame", I.AT).agg(seen("a"), seen("b"))
    g = g.select("session_id", "frame", I.AT, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("x", "y", "py", "conf")])
    return triangulated(g, "a", "b", CAM_A, CAM_B)


def fused(spark, sf, files=4):
    rows = camera_rows(spark, sf).withColumn("t", F.col("frame") / 25)
    return I.in_order(fusion_frames(I.replayed(rows, "t", files)), KEYS, S.fusion(), None)


@query("x8_fusion_modes", FUSION_SQL)
def _(spark, sf):
    t = I.drained(fused(spark, sf), "fused").where("kind = 'mode'")
    return t.select("session_id", "frame", "mode", r("x", 5).alias("x"), r("z", 5).alias("z"))


@query("x8_fusion_stream")
def _(spark, sf):
    t = I.drained(fused(spark, sf), "fused").where("kind <> 'mode'")
    return t.drop("event_time", "seq").withColumns({c: r(c, 5) for c in ("x", "y", "z", "confidence")})


@query("x13_stream_reports", f"""WITH {_RALLIES_SQL.format(pause=37)},
t AS (SELECT session_id, rally AS rallies, SUM(strokes) OVER w AS strokes, SUM(bounces) OVER w AS bounces, SUM(s) OVER w AS play_s FROM ra WINDOW w AS (PARTITION BY session_id ORDER BY rally))
SELECT session_id, rallies, CAST(strokes AS BIGINT) AS strokes, CAST(bounces AS BIGINT) AS bounces, ROUND(play_s, 6) AS play_s FROM t WHERE rallies % 2 = 0""")
def _(spark, sf):
    return RP.reports(live_rallies(spark, sf, timeout=1.5), every=2).withColumn("play_s", r("play_s"))


def blob_rows(spark, sf):
    return table(spark, sf, "cands").select("session_id", F.when(F.col("camera") == "cam66", "a").otherwise("b").alias("side"), "frame", "rank", (F.col("frame") / 25).alias("t"),
                                            "pixel_x", "pixel_y", "world_x", "world_y")


BLOCKS = {"block": 200, "max_px": 120.0, "min_rows": 5, "min_common": 4}


@query("x10_block_tracks")
def _(spark, sf):
    t = I.drained(I.in_order(I.replayed(blob_rows(spark, sf), "t", 5), KEYS, TK.block_tracks(CAM_A, CAM_B, **BLOCKS)), "tracks")
    return t.drop("event_time").withColumns({c: r(c, 5) for c in ("x", "y", "z", "ray_dist")})
