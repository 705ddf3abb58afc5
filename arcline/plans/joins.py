"""Queries over the time and frame joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import align as AL
from ..operators import joins as J
from ..operators import motion as M
from ..session import cut_lineage
from .fixtures import CAM_A, CAM_B, CAMERAS, CAMERA_COLS, table
from .geometry import _tri_sql
from .registry import query, r

KEYS = ["session_id"]


@query("j1_two_camera_join", """
SELECT a.session_id, a.frame, ROUND(a.world_x, 6) AS ax, ROUND(b.world_x, 6) AS bx
FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame""")
def _(spark, sf):
    a, b = (J.last_per_frame(table(spark, sf, t), KEYS) for t in ("det66", "det68"))
    return J.pair_frames(a, b).select("session_id", "frame", r("a_x").alias("ax"), r("b_x").alias("bx"))


def greedy_sql(driver: str, partner: str, tol: int, policy: str, strict: bool = False, final: str = "") -> str:
    order = "ABS(p.tt - d.tt), p.tt" if policy != "first_within" else "p.tt"
    free = "LIST_FILTER(d.cs, lambda c: NOT LIST_CONTAINS(g.used, c))[1]"
    if policy == "nearest_then_check":
        free = "CASE WHEN NOT LIST_CONTAINS(g.used, d.cs[1]) THEN d.cs[1] END"
    cmp = "<" if strict else "<="
    return f"""
WITH RECURSIVE dr AS ({driver}), pa AS ({partner}),
cd AS (SELECT d.session_id, d.tt, LIST(p.tt ORDER BY {order}) FILTER (p.tt IS NOT NULL) AS cs FROM dr d
  LEFT JOIN pa p ON p.session_id = d.session_id AND ABS(p.tt - d.tt) {cmp} {tol} GROUP BY d.session_id, d.tt),
d AS (SELECT session_id, tt, COALESCE(cs, CAST([] AS BIGINT[])) AS cs, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY tt) AS i FROM cd),
g AS (SELECT session_id, i, tt, cs[1] AS pick, CASE WHEN cs[1] IS NULL THEN CAST([] AS BIGINT[]) ELSE [cs[1]] END AS used FROM d WHERE i = 1
  UNION ALL SELECT d.session_id, d.i, d.tt, {free},
    CASE WHEN {free} IS NULL THEN g.used ELSE LIST_APPEND(LIST_FILTER(g.used, lambda u: u >= d.tt - {tol}), {free}) END
  FROM g JOIN d ON d.session_id = g.session_id AND d.i = g.i + 1)
{final or 'SELECT session_id, tt AS driver_at, pick AS partner_at FROM g'}"""


_DET = "SELECT session_id, frame AS tt FROM {}"


@query("j2_nearest_time_pairing", greedy_sql(
    "SELECT session_id, frame * 40 AS tt FROM det66", "SELECT session_id, frame * 40 + 13 AS tt FROM det68", 2000, "nearest_unused", True))
def _(spark, sf):
    a = table(spark, sf, "det66").withColumn("ms", F.col("frame") * 40)
    b = table(spark, sf, "det68").withColumn("ms", F.col("frame") * 40 + 13)
    return J.match_one_to_one(a, b, KEYS, "ms", 2000, strict=True, unit=40)


def _match(name, driver, partner, tol, policy):
    @query(name, greedy_sql(_DET.format(driver), _DET.format(partner), tol, policy))
    def _(spark, sf):
        return J.match_one_to_one(table(spark, sf, driver), table(spark, sf, partner), KEYS, "frame", tol, policy)


_match("j14_match_events_by_truth", "gt_events", "det_events", 5, "nearest_unused")
_match("j15_match_events_by_detection", "det_events", "gt_events", 5, "nearest_unused")
_match("j16_match_nearest_then_check", "det_events", "gt_events", 7, "nearest_then_check")
_match("j16_match_first_within", "gt_events", "det_events", 3, "first_within")


@query("j16_exists_within", """
SELECT g.session_id, COUNT(*) AS gt_total, COUNT(*) FILTER (EXISTS (SELECT 1 FROM det_events d
  WHERE d.session_id = g.session_id AND ABS(d.frame - g.frame) <= 3)) AS tp FROM gt_events g GROUP BY g.session_id""")
def _(spark, sf):
    gt, det = table(spark, sf, "gt_events"), table(spark, sf, "det_events").select("session_id", F.col("frame").alias("df"))
    hit = J.band_join(gt, det, KEYS, "frame", "df", 3, 3, "left_semi").select("session_id", "frame", F.lit(1).alias("hit"))
    return gt.join(hit, ["session_id", "frame"], "left").groupBy("session_id").agg(
        F.count("*").alias("gt_total"), F.count("hit").alias("tp"))


@query("j3_interpolating_asof", """
WITH q AS (SELECT session_id, frame, frame + 0.25 AS f FROM det66),
p AS (SELECT q.session_id, q.frame, q.f, (SELECT MAX(b.frame) FROM det68 b WHERE b.session_id = q.session_id AND b.frame <= q.f) AS f0,
  (SELECT MIN(b.frame) FROM det68 b WHERE b.session_id = q.session_id AND b.frame >= q.f) AS f1 FROM q)
SELECT p.session_id, p.frame, ROUND(a.pixel_x + CASE WHEN f1 = f0 THEN 0 ELSE (f - f0) / (f1 - f0) END * (b.pixel_x - a.pixel_x), 5) AS px,
  ROUND(a.pixel_y + CASE WHEN f1 = f0 THEN 0 ELSE (f - f0) / (f1 - f0) END * (b.pixel_y - a.pixel_y), 5) AS py
FROM p JOIN det68 a ON a.session_id = p.session_id AND a.frame = f0 JOIN det68 b ON b.session_id = p.session_id AND b.frame = f1""")
def _(spark, sf):
    a = table(spark, sf, "det66").select("session_id", "frame", (F.col("frame") + 0.25).alias("f"))
    j = J.interpolate_at(a, table(spark, sf, "det68"), KEYS, "f", ["pixel_x", "pixel_y"], scale=4)
    return j.select("session_id", "frame", r("i_pixel_x", 5).alias("px"), r("i_pixel_y", 5).alias("py"))


def _ab(spark, sf):
    return table(spark, sf, "det66"), table(spark, sf, "det68")


@query("j4_time_offset_sweep")
def _(spark, sf):
    a, b = _ab(spark, sf)
    best = AL.best_time_offset(a, b, table(spark, sf, "cams"), CAM_A, CAM_B)
    return best.select("session_id", r("dt").alias("dt"), r("cost").alias("cost"))


@query("a8_trimmed_mean_cost", """
WITH s AS (SELECT session_id, ray_dist, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ray_dist) AS i,
  GREATEST(1, CAST(FLOOR(COUNT(*) OVER (PARTITION BY session_id) * 0.8) AS BIGINT)) AS k FROM points)
SELECT session_id, ROUND(AVG(ray_dist), 6) AS cost FROM s WHERE i <= k GROUP BY session_id""")
def _(spark, sf):
    t = J.trimmed_mean(table(spark, sf, "points"), KEYS, "ray_dist")
    return t.select("session_id", r("cost").alias("cost"))


_J5 = _tri_sql("", bounded=True).replace("FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame",
    "FROM det66 a CROSS JOIN (SELECT UNNEST(RANGE(25)) AS k) o JOIN det68 b ON a.session_id = b.session_id AND b.frame = a.frame - o.k").replace(
    "SELECT a.session_id, a.frame,", "SELECT a.session_id, a.frame, o.k,").replace("SELECT session_id, frame, (a0", "SELECT session_id, frame, k, (a0")


@query("j5_integer_offset_sweep", _J5 + """,
m5 AS (SELECT session_id, k, COUNT(*) AS n, AVG(rd) AS m FROM tri GROUP BY session_id, k)
SELECT session_id, k AS best_offset, n, ROUND(m, 6) AS mean_ray FROM m5 QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ROUND(m, 9), k) = 1""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    return AL.best_frame_offset(a, b, CAM_A, CAM_B).select("session_id", "best_offset", "n", r("mean_ray").alias("mean_ray"))


@query("j6_lag_correlation", """
WITH sa AS (SELECT session_id, frame, AVG(pixel_x) OVER (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS v FROM det66),
sb AS (SELECT session_id, frame, AVG(pixel_x) OVER (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS v FROM det68),
c AS (SELECT sa.session_id, l.k AS lag, COUNT(*) AS n, CORR(sa.v, sb.v) AS c FROM sa CROSS JOIN (SELECT UNNEST(RANGE(-200, 201)) AS k) l
  JOIN sb ON sb.session_id = sa.session_id AND sb.frame = sa.frame - l.k GROUP BY sa.session_id, l.k HAVING COUNT(*) >= 100),
m AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ROUND(c, 9) DESC, lag) = 1)
SELECT s.session_id, lag AS best_lag, n, ROUND(c, 5) AS corr FROM (SELECT DISTINCT session_id FROM sa) s LEFT JOIN m ON m.session_id = s.session_id""")
def _(spark, sf):
    a, b = (t.select("session_id", "frame", F.col("pixel_x").alias("v")) for t in _ab(spark, sf))
    return AL.best_lag(AL.moving_mean(a, 10, 9), AL.moving_mean(b, 10, 9)).select("session_id", "best_lag", "n", r("corr", 5).alias("corr"))


EQUALISED = """
sa AS (SELECT session_id, frame, CAST(FLOOR(frame / 25.0) AS BIGINT) AS sec, ROW_NUMBER() OVER (PARTITION BY session_id, CAST(FLOOR(frame / 25.0) AS BIGINT) ORDER BY frame) - 1 AS i,
  COUNT(*) OVER (PARTITION BY session_id, CAST(FLOOR(frame / 25.0) AS BIGINT)) AS n FROM det66),
sb AS (SELECT session_id, frame, CAST(FLOOR(frame / 25.0) AS BIGINT) AS sec, ROW_NUMBER() OVER (PARTITION BY session_id, CAST(FLOOR(frame / 25.0) AS BIGINT) ORDER BY frame) - 1 AS i,
  COUNT(*) OVER (PARTITION BY session_id, CAST(FLOOR(frame / 25.0) AS BIGINT)) AS n FROM det68),
ct AS (SELECT DISTINCT sa.session_id, sa.sec, sa.n AS na, sb.n AS nb, LEAST(sa.n, sb.n) AS m FROM sa JOIN sb ON sa.session_id = sb.session_id AND sa.sec = sb.sec),
sl AS (SELECT ct.*, UNNEST(RANGE(m)) AS slot FROM ct),
ix AS (SELECT *, CAST(ROUND_EVEN(CASE WHEN m = 1 THEN 0 ELSE slot * (CAST(na - 1 AS DOUBLE) / (m - 1)) END, 0) AS BIGINT) AS ia,
  CAST(ROUND_EVEN(CASE WHEN m = 1 THEN 0 ELSE slot * (CAST(nb - 1 AS DOUBLE) / (m - 1)) END, 0) AS BIGINT) AS ib FROM sl),
pr AS (SELECT ix.session_id, ix.sec, ix.slot, sa.frame AS frame_a, sb.frame AS frame_b FROM ix
  JOIN sa ON sa.session_id = ix.session_id AND sa.sec = ix.sec AND sa.i = ix.ia JOIN sb ON sb.session_id = ix.session_id AND sb.sec = ix.sec AND sb.i = ix.ib)"""


@query("j7_second_alignment", f"WITH {EQUALISED} SELECT * FROM pr")
def _(spark, sf):
    a, b = _ab(spark, sf)
    sec = F.floor(F.col("frame") / 25.0).cast("long")
    return AL.align_seconds(a.withColumn("sec", sec), b.withColumn("sec", sec))


@query("j8_piecewise_frame_map", f"""WITH {EQUALISED},
bd AS (SELECT session_id, frame_a AS a, frame_b AS b FROM pr WHERE slot = 0),
pt AS (SELECT p.session_id, p.frame, (SELECT MAX(a) FROM bd WHERE bd.session_id = p.session_id AND a <= p.frame) AS a0,
  (SELECT MIN(a) FROM bd WHERE bd.session_id = p.session_id AND a >= p.frame) AS a1 FROM points p)
SELECT pt.session_id, pt.frame, CASE WHEN x.a IS NULL THEN pt.frame + y.b - y.a WHEN y.a IS NULL THEN pt.frame + x.b - x.a
  WHEN x.a = y.a THEN x.b ELSE CAST(ROUND_EVEN(x.b + (CAST(pt.frame - x.a AS DOUBLE) / (y.a - x.a)) * (y.b - x.b), 0) AS BIGINT) END AS frame_b
FROM pt LEFT JOIN bd x ON x.session_id = pt.session_id AND x.a = pt.a0 LEFT JOIN bd y ON y.session_id = pt.session_id AND y.a = pt.a1""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    sec = F.floor(F.col("frame") / 25.0).cast("long")
    pairs = AL.align_seconds(a.withColumn("sec", sec), b.withColumn("sec", sec))
    return AL.map_frames(table(spark, sf, "points").select("session_id", "frame"), AL.boundaries(pairs))


_PAIRS = _tri_sql("", bounded=True).replace(
    "FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame",
    "FROM (SELECT * FROM cands WHERE camera = 'cam66') a JOIN (SELECT * FROM cands WHERE camera = 'cam68') b ON a.session_id = b.session_id AND a.frame = b.frame").replace(
    "SELECT a.session_id, a.frame,", "SELECT a.session_id, a.frame, a.rank AS ra, b.rank AS rb,").replace(
    "SELECT session_id, frame, (a0", "SELECT session_id, frame, ra, rb, (a0")


def pairs(spark, sf, **kw):
    c = table(spark, sf, "cands")
    return J.candidate_pairs(c.where("camera = 'cam66'"), c.where("camera = 'cam68'"), CAM_A, CAM_B, **kw)


@query("j9_best_candidate_pair", _PAIRS + """
SELECT session_id, frame, ra AS a_rank, rb AS b_rank, ROUND(rd, 4) AS ray_dist, ROUND(z, 4) AS z FROM tri WHERE rd <= 2.0 AND z BETWEEN 0 AND 8
QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, frame ORDER BY rd + 0.5 * (ra + rb), ra, rb) = 1""")
def _(spark, sf):
    return J.best_pairs(pairs(spark, sf)).select("session_id", "frame", "a_rank", "b_rank", r("ray_dist", 4).alias("ray_dist"), r("z", 4).alias("z"))


@query("j9_tracked_candidate_pair")
def _(spark, sf):
    return J.track_pairs(pairs(spark, sf)).select("session_id", "frame", "a_rank", "b_rank", r("ray_dist", 4).alias("ray_dist"), "tracking", "assisted")


@query("a29_matcher_stats")
def _(spark, sf):
    total = pairs(spark, sf, max_ray=1e9, z=(-1e9, 1e9)).select("session_id", "frame").distinct().groupBy("session_id").agg(F.count("*").alias("total_frames"))
    t = J.track_pairs(pairs(spark, sf)).groupBy("session_id").agg(
        F.count("*").alias("matched_frames"), F.count_if((F.col("a_rank") > 0) | (F.col("b_rank") > 0)).alias("non_top1"),
        F.count_if("assisted").alias("temporal_assists"))
    return total.join(t, "session_id", "left").withColumn("non_top1_rate", r(F.col("non_top1") / F.col("matched_frames")))


@query("j13_rows_in_windows", """
WITH w AS (SELECT session_id, frame AS start_f, frame + 40 AS end_f FROM gt_events)
SELECT p.session_id, w.start_f, COUNT(*) AS n, ROUND(AVG(p.z), 6) AS z FROM points p JOIN w ON p.session_id = w.session_id AND p.frame BETWEEN w.start_f AND w.end_f
GROUP BY p.session_id, w.start_f""")
def _(spark, sf):
    w = table(spark, sf, "gt_events").select("session_id", F.col("frame").alias("start_f"), (F.col("frame") + 40).alias("end_f"))
    j = J.interval_join(table(spark, sf, "points"), w, KEYS, "frame", "start_f", "end_f", 64)
    return j.groupBy("session_id", "start_f").agg(F.count("*").alias("n"), r(F.avg("z")).alias("z"))


NC = "SELECT session_id, frame, y > py AS up FROM (SELECT session_id, frame, y, LAG(y) OVER (PARTITION BY session_id ORDER BY frame) AS py, frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) AS gap FROM points) WHERE gap <= 5 AND ((py < 0 AND y >= 0) OR (py >= 0 AND y < 0))"


def crossings(spark, sf):
    c = M.crossings_twopoint(table(spark, sf, "points"))
    return c.select("session_id", F.col("frame").alias("cf"), "y")


@query("j17_near_crossing_semi", f"WITH nc AS ({NC}) SELECT session_id, frame FROM gt_events g WHERE EXISTS (SELECT 1 FROM nc WHERE nc.session_id = g.session_id AND ABS(nc.frame - g.frame) <= 4)")
def _(spark, sf):
    return J.band_join(table(spark, sf, "gt_events"), crossings(spark, sf), KEYS, "frame", "cf", 4, 4, "left_semi").select("session_id", "frame")


@query("j31_no_crossing_anti", f"WITH nc AS ({NC}) SELECT session_id, frame FROM gt_events g WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.session_id = g.session_id AND nc.frame BETWEEN g.frame - 3 AND g.frame + 6)")
def _(spark, sf):
    return J.band_join(table(spark, sf, "gt_events"), crossings(spark, sf), KEYS, "frame", "cf", 3, 6, "left_anti").select("session_id", "frame")


_H = {row[0]: dict(zip(CAMERA_COLS, row)) for row in CAMERAS}


@query("j18_landing_camera_asof", f"""
WITH nc AS ({NC}),
b AS (SELECT g.session_id, g.frame, g.y, (SELECT MAX(frame) FROM nc WHERE nc.session_id = g.session_id AND nc.frame <= g.frame) AS cf,
  (SELECT ARG_MIN(p.frame, (p.z, CASE WHEN p.frame = g.frame THEN 0 ELSE 1 END, p.frame)) FROM points p WHERE p.session_id = g.session_id AND p.frame BETWEEN g.frame - 3 AND g.frame + 3) AS low_frame,
  (SELECT MIN(p.z) FROM points p WHERE p.session_id = g.session_id AND p.frame BETWEEN g.frame - 3 AND g.frame + 3) AS low_z FROM gt_events g),
c AS (SELECT b.*, COALESCE(nc.up, b.y > 0) AS far FROM b LEFT JOIN nc ON nc.session_id = b.session_id AND nc.frame = b.cf)
SELECT c.session_id, c.frame, c.low_frame, ROUND(c.low_z, 6) AS low_z,
  CASE WHEN c.low_z > 0.35 THEN '3d' WHEN far AND d.frame IS NOT NULL THEN 'cam68' WHEN NOT far AND a.frame IS NOT NULL THEN 'cam66'
       WHEN a.frame IS NOT NULL THEN 'cam66' WHEN d.frame IS NOT NULL THEN 'cam68' ELSE '3d' END AS cam_used,
  ROUND(CASE WHEN c.low_z > 0.35 THEN NULL WHEN far AND d.frame IS NOT NULL THEN d.world_x WHEN a.frame IS NOT NULL THEN a.world_x ELSE d.world_x END, 5) AS x_homo
FROM c LEFT JOIN det66 a ON a.session_id = c.session_id AND a.frame = c.low_frame LEFT JOIN det68 d ON d.session_id = c.session_id AND d.frame = c.low_frame""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    cr = crossings(spark, sf).join(M.crossings_twopoint(table(spark, sf, "points")).select("session_id", F.col("frame").alias("cf")), ["session_id", "cf"])
    cr = cr.select("session_id", F.col("cf").alias("frame"), (F.col("y") >= 0).alias("up"))
    out = AL.landing_by_camera(table(spark, sf, "gt_events"), table(spark, sf, "points"), cr, a, b, table(spark, sf, "cams"))
    return out.select("session_id", "frame", "low_frame", r("low_z").alias("low_z"), "cam_used", r("x_homo", 5).alias("x_homo"))


@query("j20_pose_nearest_player", """
WITH b AS (SELECT p.session_id, p.frame, p.near_x, p.near_y, p.far_x, p.far_y,
  (SELECT MAX(g.frame) FROM gt_events g WHERE g.session_id = p.session_id AND g.frame <= p.frame) AS bf FROM play p),
c AS (SELECT b.*, g.x AS bx, g.y AS by_, SQRT((near_x-g.x)*(near_x-g.x) + (near_y-g.y)*(near_y-g.y)) AS dn,
  SQRT((far_x-g.x)*(far_x-g.x) + (far_y-g.y)*(far_y-g.y)) AS df FROM b LEFT JOIN gt_events g ON g.session_id = b.session_id AND g.frame = b.bf)
SELECT session_id, frame, CASE WHEN bf IS NULL THEN 'none' WHEN dn IS NULL AND df IS NULL THEN 'none' WHEN df IS NULL OR dn <= df THEN 'near' ELSE 'far' END AS player,
  ROUND(CASE WHEN bf IS NULL OR (dn IS NULL AND df IS NULL) THEN -1 WHEN df IS NULL OR dn <= df THEN dn ELSE df END, 6) AS dist FROM c""")
def _(spark, sf):
    return AL.nearest_player(table(spark, sf, "play"), table(spark, sf, "gt_events")).select("session_id", "frame", "player", r("dist").alias("dist"))


@query("j21_cross_camera_validate", """
SELECT a.session_id, a.frame FROM det66 a LEFT JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame
WHERE b.frame IS NULL OR SQRT((a.world_x-b.world_x)*(a.world_x-b.world_x) + (a.world_y-b.world_y)*(a.world_y-b.world_y)) <= 3""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    return J.validate_across(a, b, 3.0).select("session_id", "frame")


@query("j22_cross_camera_rescue", """
WITH o AS (SELECT session_id, frame, world_x, world_y, (960 + 64 * world_x + 2 * world_y) / (1 + world_y / 128) AS px, (540 - 24 * world_y + world_x) / (1 + world_y / 128) AS py FROM det68),
m AS (SELECT o.*, (SELECT MAX(a.frame) FROM det66 a WHERE a.session_id = o.session_id AND a.frame < o.frame) AS pf,
  (SELECT MIN(a.frame) FROM det66 a WHERE a.session_id = o.session_id AND a.frame > o.frame) AS nf FROM o
  WHERE NOT EXISTS (SELECT 1 FROM det66 a WHERE a.session_id = o.session_id AND a.frame = o.frame) AND px BETWEEN 0 AND 1920 AND py BETWEEN 0 AND 1080),
n AS (SELECT m.*, LEAST(COALESCE(m.frame - pf, 999), COALESCE(nf - m.frame, 999)) AS g,
  COALESCE(m.frame - pf <= 10 AND SQRT((px-p.pixel_x)*(px-p.pixel_x) + (py-p.pixel_y)*(py-p.pixel_y)) <= 40 * (m.frame - pf), FALSE)
  OR COALESCE(nf - m.frame <= 10 AND SQRT((px-q.pixel_x)*(px-q.pixel_x) + (py-q.pixel_y)*(py-q.pixel_y)) <= 40 * (nf - m.frame), FALSE) AS cons
  FROM m LEFT JOIN det66 p ON p.session_id = m.session_id AND p.frame = m.pf LEFT JOIN det66 q ON q.session_id = m.session_id AND q.frame = m.nf)
SELECT session_id, frame, ROUND(pixel_x, 5) AS pixel_x, 'own' AS origin FROM det66
UNION ALL SELECT session_id, frame, ROUND(px, 5), 'consistent' FROM n WHERE g <= 2 AND cons
UNION ALL SELECT session_id, frame, ROUND(px, 5), 'trusted' FROM n WHERE g > 2 AND EXISTS (SELECT 1 FROM det68 b WHERE b.session_id = n.session_id AND b.frame <> n.frame
  AND ABS(b.frame - n.frame) <= 3 AND SQRT((b.world_x-n.world_x)*(b.world_x-n.world_x) + (b.world_y-n.world_y)*(b.world_y-n.world_y)) < 3)""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    other = b.select("session_id", F.lit("cam66").alias("camera"), "frame", "world_x", "world_y")
    other = G.world_to_pixel(other, table(spark, sf, "cams"))
    return J.rescue_across(a, other, max_px=40.0, near=2).select("session_id", "frame", r("pixel_x", 5).alias("pixel_x"), "origin")


@query("j24_detector_fusion", """
WITH a AS (SELECT session_id, camera, frame, pixel_x, pixel_y, blob_sum AS conf FROM cands WHERE rank = 0 AND blob_sum >= 20),
b AS (SELECT session_id, camera, frame, pixel_x, pixel_y, blob_sum AS conf FROM cands WHERE rank = 1 AND blob_sum >= 20),
j AS (SELECT COALESCE(a.session_id, b.session_id) AS session_id, COALESCE(a.camera, b.camera) AS camera, COALESCE(a.frame, b.frame) AS frame,
  a.pixel_x AS ax, b.pixel_x AS bx, a.conf AS ca, b.conf AS cb,
  SQRT((a.pixel_x-b.pixel_x)*(a.pixel_x-b.pixel_x) + (a.pixel_y-b.pixel_y)*(a.pixel_y-b.pixel_y)) < 40 AS close
  FROM a FULL JOIN b ON a.session_id = b.session_id AND a.camera = b.camera AND a.frame = b.frame)
SELECT session_id, camera, frame, CASE WHEN cb IS NULL THEN 'a_only' WHEN ca IS NULL THEN 'b_only' WHEN close THEN 'agree' ELSE 'disagree' END AS source,
  ROUND(CASE WHEN cb IS NULL THEN ax WHEN ca IS NULL THEN bx WHEN close THEN ax * (ca/(ca+cb)) + bx * (cb/(ca+cb)) WHEN ca >= cb THEN ax ELSE bx END, 5) AS pixel_x,
  ROUND(CASE WHEN cb IS NULL THEN ca * 0.8 WHEN ca IS NULL THEN cb * 0.8 WHEN close THEN GREATEST(ca, cb) * 1.2 ELSE GREATEST(ca, cb) * 0.7 END, 5) AS conf FROM j""")
def _(spark, sf):
    c = table(spark, sf, "cands").withColumn("conf", F.col("blob_sum")).where("conf >= 20")
    t = J.fuse_detectors(c.where("rank = 0"), c.where("rank = 1"), ["session_id", "camera", "frame"], agree=0.5)
    return t.select("session_id", "camera", "frame", "source", r("pixel_x", 5).alias("pixel_x"), r("conf", 5).alias("conf"))


FUSION_SQL = _tri_sql("""SELECT COALESCE(a.session_id, b.session_id) AS session_id, COALESCE(a.frame, b.frame) AS frame,
  CASE WHEN tri.rd < 2 THEN '3d' ELSE 'single_cam' END AS mode,
  ROUND(CASE WHEN tri.rd < 2 THEN tri.x WHEN b.frame IS NULL OR a.blob_sum >= b.blob_sum THEN a.world_x ELSE b.world_x END, 5) AS x,
  ROUND(CASE WHEN tri.rd < 2 THEN tri.z ELSE 0 END, 5) AS z
FROM det66 a FULL JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame
LEFT JOIN tri ON tri.session_id = a.session_id AND tri.frame = b.frame AND a.frame = b.frame""")


@query("j25_fusion_mode", FUSION_SQL)
def _(spark, sf):
    a, b = _ab(spark, sf)
    return J.fusion_mode(a, b, CAM_A, CAM_B).select("session_id", "frame", "mode", r("x", 5).alias("x"), r("z", 5).alias("z"))


@query("j32_constant_offset_join", """
SELECT a.session_id, a.frame, ROUND(a.world_y, 6) AS ay, ROUND(b.world_y, 6) AS by FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND b.frame = a.frame + 3""")
def _(spark, sf):
    a, b = _ab(spark, sf)
    return J.pair_frames(a, b, shift=3).select("session_id", "frame", r("a_y").alias("ay"), r("b_y").alias("by"))


@query("j19_consume_crossing_once", f"""WITH RECURSIVE nc AS ({NC}),
u AS (SELECT session_id, frame, t, x, y, 1 AS kind FROM gt_events UNION ALL SELECT session_id, frame, NULL, NULL, NULL, 0 FROM nc),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame, kind) AS i FROM u),
s AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST([] AS BIGINT[]) AS free, CAST([] AS STRUCT(t DOUBLE, x DOUBLE, y DOUBLE)[]) AS acc, CAST(NULL AS BIGINT) AS taken, CAST(NULL AS VARCHAR) AS verdict FROM q
  UNION ALL SELECT session_id, i, frame, CASE WHEN kind = 0 THEN LIST_APPEND(fr, frame) WHEN verdict = 'accepted' THEN COALESCE(fr[:-2], []) ELSE fr END,
    CASE WHEN verdict = 'accepted' THEN LIST_APPEND(acc, {{'t': t, 'x': x, 'y': y}})[-5:] ELSE acc END, CASE WHEN kind = 1 THEN fr[-1] END, verdict FROM (
    SELECT q.*, LIST_FILTER(s.free, lambda c: q.frame - c < 75) AS fr, s.acc, CASE WHEN q.kind = 0 THEN NULL
      WHEN LEN(LIST_FILTER(s.acc, lambda p: q.t - p.t BETWEEN 0 AND 0.7 AND SQRT((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 1)) > 0 THEN 'duplicate'
      WHEN q.t - s.acc[-1].t >= 0 AND q.t - s.acc[-1].t < 0.4 AND (s.acc[-1].y < 0) = (q.y < 0) AND SQRT((q.x - s.acc[-1].x) * (q.x - s.acc[-1].x) + (q.y - s.acc[-1].y) * (q.y - s.acc[-1].y)) < 2 THEN 'f2_min_interval' ELSE 'accepted' END AS verdict
    FROM s JOIN q ON q.session_id = s.session_id AND q.i = s.i + 1) a)
SELECT session_id, frame, taken AS crossing_frame, verdict FROM s WHERE verdict IS NOT NULL""")
def _(spark, sf):
    return AL.assign_crossings(table(spark, sf, "gt_events"), crossings(spark, sf), window=75)
