"""Row math: projections, triangulation, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..court import COURT, in_court
from ..functions import geometry as G
from ..operators import predicates as P
from .fixtures import CAM_A, CAM_B, table
from .registry import query, r


@query("p1_pixel_to_world", """
SELECT d.session_id, d.camera, d.frame,
       ROUND((h00*pixel_x + h01*pixel_y + h02) / (h20*pixel_x + h21*pixel_y + h22), 6) AS wx,
       ROUND((h10*pixel_x + h11*pixel_y + h12) / (h20*pixel_x + h21*pixel_y + h22), 6) AS wy
FROM det d JOIN cams c ON d.camera = c.camera""")
def _(spark, sf):
    d = G.pixel_to_world(table(spark, sf, "det"), table(spark, sf, "cams"), out=("wx", "wy"))
    return d.select("session_id", "camera", "frame", r("wx").alias("wx"), r("wy").alias("wy"))


@query("p2_world_to_pixel", """
SELECT d.session_id, d.camera, d.frame,
       ROUND((g00*world_x + g01*world_y + g02) / (g20*world_x + g21*world_y + g22), 6) AS px,
       ROUND((g10*world_x + g11*world_y + g12) / (g20*world_x + g21*world_y + g22), 6) AS py
FROM det d JOIN cams c ON d.camera = c.camera""")
def _(spark, sf):
    d = G.world_to_pixel(table(spark, sf, "det"), table(spark, sf, "cams"), out=("px", "py"))
    return d.select("session_id", "camera", "frame", r("px").alias("px"), r("py").alias("py"))


@query("p3_court_x_filter", """
SELECT session_id, camera, frame, rank, ROUND(world_x, 6) AS world_x FROM cands
WHERE world_x BETWEEN -5.115 AND 5.115""")
def _(spark, sf):
    c = table(spark, sf, "cands").where(G.in_court_x(F.col("world_x")))
    return c.select("session_id", "camera", "frame", "rank", r("world_x").alias("world_x"))


@query("p4_in_court_variants", """
SELECT session_id, frame,
       ABS(x) <= 4.265 AND ABS(y) <= 12.035 AS with_margin,
       ABS(x) <= 4.115 AND ABS(y) <= 11.885 AS strict,
       NOT (ABS(y) < 1.5 OR ABS(x) > 4.115 OR ABS(y) > 11.885) AS judged_in,
       ABS(x) <= 4.115 AND y > 0 AND y < 6.4 AS near_serve_box,
       ABS(x) <= 4.115 AND y < 0 AND y > -6.4 AS far_serve_box
FROM points""")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return table(spark, sf, "points").select(
        "session_id", "frame", in_court(x, y, COURT.in_margin).alias("with_margin"), in_court(x, y).alias("strict"),
        (G.judge(x, y) == "in").alias("judged_in"),
        P.serve_box(x, y, F.lit("near")).alias("near_serve_box"), P.serve_box(x, y, F.lit("far")).alias("far_serve_box"))


@query("p5_judge_in_out", """
SELECT session_id, frame, ROUND(x, 6) AS x, ROUND(y, 6) AS y,
       CASE WHEN ABS(y) < 1.5 THEN 'net' WHEN ABS(x) > 4.115 THEN 'wide' WHEN ABS(y) > 11.885 THEN 'long' ELSE 'in' END AS reason,
       ABS(y) < 1.5 OR ABS(x) > 4.115 OR ABS(y) > 11.885 AS is_out,
       CASE WHEN y < 0 THEN 'near' ELSE 'far' END AS side
FROM gt_events""")
def _(spark, sf):
    return P.judge_landings(table(spark, sf, "gt_events")).select(
        "session_id", "frame", r("x").alias("x"), r("y").alias("y"), "reason", "is_out", "side")


@query("p6_two_camera_agreement", """
SELECT a.session_id, a.frame, ROUND(p.x, 6) AS x, ROUND(p.y, 6) AS y, ROUND(p.z, 6) AS z
FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame
JOIN points p ON p.session_id = a.session_id AND p.frame = a.frame
WHERE a.blob_sum <= 150 AND b.blob_sum <= 150 AND NOT (a.blob_sum < 15 AND b.blob_sum < 15)
  AND SQRT((a.world_x - b.world_x)*(a.world_x - b.world_x) + (a.world_y - b.world_y)*(a.world_y - b.world_y)) <= 8""")
def _(spark, sf):
    return P.agreeing_frames(tracking_rows(spark, sf)).select(
        "session_id", "frame", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


def tracking_rows(spark, sf):
    """Tracking-log shaped rows: one struct per camera and the 3-D point."""
    cam = lambda t, n: table(spark, sf, t).select(
        "session_id", "frame", F.struct(F.col("pixel_x").alias("px"), F.col("pixel_y").alias("py"),
                                        F.col("blob_sum").alias("conf"), F.col("world_x").alias("wx"),
                                        F.col("world_y").alias("wy")).alias(n))
    pts = table(spark, sf, "points").select("session_id", "frame", F.col("t").alias("ts"),
                                            F.struct("x", "y", "z").alias("raw"))
    return (pts.join(cam("det66", "cam66"), ["session_id", "frame"], "left")
            .join(cam("det68", "cam68"), ["session_id", "frame"], "left")
            .withColumn("smoothed", F.lit(None).cast("struct<x:double,y:double,z:double>")))


@query("p7_clean_counts", """
SELECT camera, COUNT(*) AS n_input, COUNT(*) FILTER (blob_sum >= 3) AS after_confidence,
       COUNT(*) FILTER (blob_sum >= 3 AND ABS(world_x) <= 9.115 AND ABS(world_y) <= 16.885) AS after_bounds
FROM det GROUP BY camera""")
def _(spark, sf):
    return P.clean_counts(table(spark, sf, "det"), ["camera"])


@query("p8_reject_triangulation", """
SELECT session_id, COUNT(*) FILTER (ray_dist > 1.5) AS rejected_ray,
       COUNT(*) FILTER (ray_dist <= 1.5 AND (z < -0.5 OR z > 8)) AS rejected_physics,
       COUNT(*) FILTER (ray_dist <= 1.5 AND z >= -0.5 AND z <= 8) AS kept,
       COUNT(*) FILTER (ABS(x) <= 20 AND ABS(y) <= 30 AND z <= 10) AS sane
FROM points GROUP BY session_id""")
def _(spark, sf):
    return P.reject_counts(table(spark, sf, "points"), ["session_id"])


@query("p12_normalised_coords", """
SELECT session_id, frame, ROUND(LEAST(GREATEST((x + 4.115) / 8.23, 0), 1), 4) AS nx,
       ROUND(LEAST(GREATEST((y + 11.885) / 23.77, 0), 1), 4) AS ny FROM points""")
def _(spark, sf):
    return table(spark, sf, "points").select(
        "session_id", "frame", P.norm_x(F.col("x")).alias("nx"), P.norm_y(F.col("y")).alias("ny"))


@query("p13_clamped_speed", """
SELECT session_id, frame, ROUND(LEAST(GREATEST(speed_kmh, 50), 150), 1) AS speed FROM play""")
def _(spark, sf):
    return table(spark, sf, "play").select("session_id", "frame", P.clamp_speed(F.col("speed_kmh")).alias("speed"))


@query("p14_hand_type", """
SELECT session_id, frame, CASE WHEN wrist_conf < 0.3 THEN 'forehand' WHEN shoulder_x > wrist_x THEN 'backhand' ELSE 'forehand' END AS hand
FROM play""")
def _(spark, sf):
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    kp = F.concat(F.array_repeat(zero, 6), F.array(F.array("shoulder_x", F.lit(0.0), F.lit(0.9))),
                  F.array_repeat(zero, 3), F.array(F.array("wrist_x", F.lit(0.0), "wrist_conf")))
    return table(spark, sf, "play").select("session_id", "frame", P.hand_type(kp).alias("hand"))


@query("p15_side_and_zone", """
SELECT session_id, frame, CASE WHEN y < 0 THEN 'near' ELSE 'far' END AS side, y < -6.885 OR y > 6.885 AS baseline FROM points""")
def _(spark, sf):
    y = F.col("y")
    return table(spark, sf, "points").select("session_id", "frame", G.side(y).alias("side"), P.baseline_zone(y).alias("baseline"))


@query("p17_player_half_filter", """
SELECT session_id, frame, 'cam66' AS camera, ROUND(near_y, 6) AS foot_y FROM play WHERE near_y <= 0.5
UNION ALL SELECT session_id, frame, 'cam68' AS camera, ROUND(far_y, 6) AS foot_y FROM play WHERE far_y >= -0.5""")
def _(spark, sf):
    p = table(spark, sf, "play")
    feet = p.select("session_id", "frame", F.lit("cam66").alias("camera"), F.col("near_y").alias("foot_y")).unionByName(
        p.select("session_id", "frame", F.lit("cam68").alias("camera"), F.col("far_y").alias("foot_y")))
    return feet.where(P.own_half(F.col("camera"), F.col("foot_y"))).withColumn("foot_y", r("foot_y"))


@query("p18_round_trip", """
SELECT session_id, frame, ROUND(x, 4) AS x, ROUND(y, 4) AS y, ROUND(z, 4) AS z FROM points""")
def _(spark, sf):
    p = table(spark, sf, "points").select("session_id", "frame", "x", "y", "z")
    both = G.ground_projection(G.ground_projection(p, CAM_A, ("a_x", "a_y")), CAM_B, ("b_x", "b_y")).drop("x", "y", "z")
    t = G.triangulated(both, "a", "b", CAM_A, CAM_B)
    return t.select("session_id", "frame", *[r(c, 4).alias(c) for c in "xyz"])


@query("p19_display_coords", """
SELECT session_id, frame, x * 10 AS sx, y * 10 AS sy, z * 10 AS sz,
       ROUND((x + 4.115) / 8.23, 6) AS dx, ROUND(1 - (y + 11.885) / 23.77, 6) AS dy FROM points""")
def _(spark, sf):
    return P.display_coords(table(spark, sf, "points")).select(
        "session_id", "frame", "sx", "sy", "sz", r("dx").alias("dx"), r("dy").alias("dy"))


@query("p20_frame_range", """
SELECT session_id, frame, x, y, z FROM points WHERE frame BETWEEN 100 AND 300""")
def _(spark, sf):
    return P.frame_range(table(spark, sf, "points"), 100, 300).select("session_id", "frame", "x", "y", "z")


@query("p21_bounce_height_gate", """
SELECT session_id, frame, z FROM points WHERE z <= CASE WHEN y > 0 THEN 0.65 ELSE 0.35 END""")
def _(spark, sf):
    return P.bounce_height_gate(table(spark, sf, "points")).select("session_id", "frame", "z")


@query("p22_multi_blob_frames", """
SELECT session_id, camera, frame, COUNT(*) AS n_blobs FROM cands WHERE blob_sum >= 20
GROUP BY session_id, camera, frame HAVING COUNT(*) > 1""")
def _(spark, sf):
    return P.multi_blob_frames(table(spark, sf, "cands").where(F.col("blob_sum") >= 20))


@query("p24_rerank_candidates", """
WITH c AS (SELECT *, CAST((event_id * 7 + rank * 3) % 10 AS DOUBLE) / 10 AS vconf FROM cands),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, camera, frame ORDER BY vconf * blob_sum DESC, rank) AS rn
      FROM c WHERE vconf >= 0.3),
b AS (SELECT * FROM k WHERE rn = 1)
SELECT c.session_id, c.camera, c.frame, COALESCE(b.rank, c.rank) AS rank, b.rank IS NOT NULL AS verified
FROM c LEFT JOIN b ON b.session_id = c.session_id AND b.camera = c.camera AND b.frame = c.frame WHERE c.rank = 0""")
def _(spark, sf):
    c = table(spark, sf, "cands").withColumn("vconf", ((F.col("event_id") * 7 + F.col("rank") * 3) % 10).cast("double") / 10)
    return P.rerank(P.candidate_lists(c, "vconf"), 0.3).select(
        "session_id", "camera", "frame", F.col("best.rank").alias("rank"), "verified")


def _tri_sql(final: str, bounded: bool = True, where: str = "") -> str:
    """Triangulation twin written as successive derived columns."""
    ax, ay, az = CAM_A
    bx, by, bz = CAM_B
    clip = (lambda e: f"LEAST(GREATEST({e}, 0), 1)") if bounded else (lambda e: f"GREATEST({e}, 0)")
    again = """
u AS (SELECT *, LEAST(GREATEST(((a0 + s*p1 - b0)*q1 + (a1 + s*p2 - b1)*q2 + (a2 + s*p3 - b2)*q3) / cc, 0), 1) AS t2 FROM s1),
v AS (SELECT *, LEAST(GREATEST(((b0 + t2*q1 - a0)*p1 + (b1 + t2*q2 - a1)*p2 + (b2 + t2*q3 - a2)*p3) / aa, 0), 1) AS s2 FROM u)""" if bounded else """
v AS (SELECT *, t1 AS t2, s AS s2 FROM s1)"""
    return f"""
WITH j AS (SELECT a.session_id, a.frame, {ax} AS a0, {ay} AS a1, {az} AS a2, {bx} AS b0, {by} AS b1, {bz} AS b2,
   a.world_x - ({ax}) AS p1, a.world_y - ({ay}) AS p2, 0.0 - {az} AS p3,
   b.world_x - ({bx}) AS q1, b.world_y - ({by}) AS q2, 0.0 - {bz} AS q3
   FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame {where}),
m AS (SELECT *, p1*p1+p2*p2+p3*p3 AS aa, p1*q1+p2*q2+p3*q3 AS bb, q1*q1+q2*q2+q3*q3 AS cc,
   p1*(a0-b0)+p2*(a1-b1)+p3*(a2-b2) AS dd, q1*(a0-b0)+q2*(a1-b1)+q3*(a2-b2) AS ee FROM j),
s1 AS (SELECT *, {clip('(bb*ee-cc*dd)/(aa*cc-bb*bb)')} AS s, {clip('(aa*ee-bb*dd)/(aa*cc-bb*bb)')} AS t1 FROM m),
{again},
tri AS (SELECT session_id, frame, (a0+s2*p1 + b0+t2*q1)/2 AS x, (a1+s2*p2 + b1+t2*q2)/2 AS y,
   GREATEST((a2+s2*p3 + b2+t2*q3)/2, 0) AS z,
   SQRT((a0+s2*p1-b0-t2*q1)*(a0+s2*p1-b0-t2*q1) + (a1+s2*p2-b1-t2*q2)*(a1+s2*p2-b1-t2*q2) + (a2+s2*p3-b2-t2*q3)*(a2+s2*p3-b2-t2*q3)) AS rd FROM v)
{final}"""


def paired(spark, sf):
    a = table(spark, sf, "det66").select("session_id", "frame", F.col("world_x").alias("a_x"), F.col("world_y").alias("a_y"))
    b = table(spark, sf, "det68").select("session_id", "frame", F.col("world_x").alias("b_x"), F.col("world_y").alias("b_y"))
    return a.join(b, ["session_id", "frame"])


_XYZ = "SELECT session_id, frame, ROUND(x, 4) AS x, ROUND(y, 4) AS y, ROUND(z, 4) AS z{} FROM tri"


@query("m1_triangulate_unbounded", _tri_sql(_XYZ.format(""), bounded=False))
def _(spark, sf):
    t = G.triangulated(paired(spark, sf), "a", "b", CAM_A, CAM_B, bounded=False)
    return t.select("session_id", "frame", *[r(c, 4).alias(c) for c in "xyz"])


@query("m2_triangulate_bounded", _tri_sql(_XYZ.format(", ROUND(rd, 4) AS ray_dist")))
def _(spark, sf):
    t = G.triangulated(paired(spark, sf), "a", "b", CAM_A, CAM_B)
    return t.select("session_id", "frame", *[r(c, 4).alias(c) for c in ("x", "y", "z", "ray_dist")])
