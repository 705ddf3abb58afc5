"""Segments, speeds, shots, crossings and the per-rally summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounce as B
from ..operators import motion as M
from ..operators.ordered import segments
from ..operators.predicates import judge_landings, plausible_points
from ..session import cut_lineage
from .fixtures import table
from .registry import query, r


@query("w1_gap_segments", """
WITH f AS (SELECT *, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS b FROM points),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM f)
SELECT session_id, MIN(frame) AS seg, MAX(frame) AS last_frame, COUNT(*) AS n FROM s GROUP BY session_id, g HAVING COUNT(*) >= 5""")
def _(spark, sf):
    s = segments(table(spark, sf, "points"), M.KEYS, "frame", 3)
    return s.groupBy("session_id", "seg").agg(F.max("frame").alias("last_frame"), F.count("*").alias("n")).where("n >= 5")


# rallies as a CTE chain shared by several twins
RALLIES = """
r0 AS (SELECT * FROM points WHERE ray_dist <= 1.5 AND z BETWEEN -0.5 AND 8),
r1 AS (SELECT *, t - LAG(t) OVER w AS dt,
   SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w) + (y-LAG(y) OVER w)*(y-LAG(y) OVER w) + (z-LAG(z) OVER w)*(z-LAG(z) OVER w)) AS dist
   FROM r0 WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
r2 AS (SELECT *, CASE WHEN dt IS NULL OR dt > 1.0 OR (dt > 0.2 AND dist / dt > 80) THEN 1 ELSE 0 END AS b FROM r1),
r3 AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM r2),
r4 AS (SELECT *, MIN(frame) OVER (PARTITION BY session_id, g) AS rally, COUNT(*) OVER (PARTITION BY session_id, g) AS n,
   FIRST_VALUE(t) OVER wf AS t0, FIRST_VALUE(x) OVER wf AS x0, FIRST_VALUE(y) OVER wf AS y0, FIRST_VALUE(z) OVER wf AS z0,
   LAST_VALUE(t) OVER wf AS t1, LAST_VALUE(x) OVER wf AS x1, LAST_VALUE(y) OVER wf AS y1, LAST_VALUE(z) OVER wf AS z1
   FROM r3 WINDOW wf AS (PARTITION BY session_id, g ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rr AS (SELECT session_id, rally, frame, t, x, y, z, ray_dist FROM r4
   WHERE n >= 15 AND t1 - t0 >= 0.5 AND SQRT((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) >= 2.0)"""

SPEEDS = """
v1 AS (SELECT *, ROW_NUMBER() OVER w AS rn, t - LAG(t) OVER w AS dt,
   SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w) + (y-LAG(y) OVER w)*(y-LAG(y) OVER w) + (z-LAG(z) OVER w)*(z-LAG(z) OVER w)) AS dist
   FROM rr WINDOW w AS (PARTITION BY session_id, rally ORDER BY frame)),
v2 AS (SELECT *, CASE WHEN dt > 0 AND dt <= 0.5 THEN dist / dt * 3.6 END AS v FROM v1),
v3 AS (SELECT *, LIST_SORT(LIST(v) FILTER (v IS NOT NULL) OVER (PARTITION BY session_id, rally ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM v2),
v4 AS (SELECT *, l[LEN(l) // 2 + 1] AS med FROM v3 WHERE rn > 1),
sp AS (SELECT session_id, rally, frame, med * 0.8 AS speed_kmh FROM v4 WHERE med BETWEEN 25 AND 180)"""

SHOTS = """
h1 AS (SELECT *, y - LAG(y, 3) OVER (PARTITION BY session_id, rally ORDER BY frame) AS dy FROM rr),
h2 AS (SELECT *, SIGN(dy) AS s FROM h1 WHERE ABS(dy) >= 0.3),
h3 AS (SELECT *, LAG(s) OVER (PARTITION BY session_id, rally ORDER BY frame) AS ls FROM h2),
sh AS (SELECT session_id, rally, COUNT(*) FILTER (s <> ls) AS shots FROM h3 GROUP BY session_id, rally)"""

BOUNCES = """
b1 AS (SELECT *, LAG(z) OVER w AS pz, LEAD(z) OVER w AS nz, LAG(z, 2) OVER w AS p2, LEAD(z, 2) OVER w AS n2
   FROM rr WINDOW w AS (PARTITION BY session_id, rally ORDER BY frame)),
b2 AS (SELECT session_id, rally, frame, x, y, z, ROW_NUMBER() OVER (PARTITION BY session_id, rally ORDER BY frame) AS i FROM b1
   WHERE p2 IS NOT NULL AND n2 IS NOT NULL AND z > 0.02 AND z < 0.25 AND z < pz AND z < nz AND ABS(x) < 7 AND ABS(y) < 14),
b3 AS (SELECT session_id, rally, i, frame, frame AS anchor FROM b2 WHERE i = 1
   UNION ALL SELECT b2.session_id, b2.rally, b2.i, b2.frame, CASE WHEN b2.frame - b3.anchor <= 10 THEN b3.anchor ELSE b2.frame END
   FROM b3 JOIN b2 ON b2.session_id = b3.session_id AND b2.rally = b3.rally AND b2.i = b3.i + 1),
b4 AS (SELECT b2.*, b3.anchor, ROW_NUMBER() OVER (PARTITION BY b2.session_id, b2.rally, b3.anchor ORDER BY b2.z, b2.frame) AS k
   FROM b2 JOIN b3 ON b2.session_id = b3.session_id AND b2.rally = b3.rally AND b2.i = b3.i),
b5 AS (SELECT *, LAG(frame) OVER w AS pf, LAG(z) OVER w AS lz FROM b4 WHERE k = 1 WINDOW w AS (PARTITION BY session_id, rally ORDER BY frame)),
b6 AS (SELECT * FROM b5 WHERE NOT COALESCE(z < 0.05 AND lz < 0.05 AND frame - pf <= 30, FALSE)),
b7 AS (SELECT b6.*, ROW_NUMBER() OVER (PARTITION BY b6.session_id, b6.rally ORDER BY z, frame) AS q, LEAST(COALESCE(shots, 0) + 2, 8) AS cap
   FROM b6 LEFT JOIN sh ON sh.session_id = b6.session_id AND sh.rally = b6.rally),
bo AS (SELECT session_id, rally, frame, x, y, z FROM b7 WHERE q <= cap)"""


def rallies(spark, sf, name="points"):
    return M.segment_rallies(table(spark, sf, name).where(plausible_points()))


@query("w2_segment_rallies", f"WITH {RALLIES} SELECT session_id, rally, COUNT(*) AS n, MAX(frame) AS last_frame FROM rr GROUP BY session_id, rally")
def _(spark, sf):
    return rallies(spark, sf).groupBy("session_id", "rally").agg(F.count("*").alias("n"), F.max("frame").alias("last_frame"))


@query("w6_frame_speeds", f"WITH {RALLIES}, {SPEEDS} SELECT session_id, rally, frame, ROUND(speed_kmh, 6) AS speed_kmh FROM sp")
def _(spark, sf):
    return M.frame_speeds(rallies(spark, sf)).select("session_id", "rally", "frame", r("speed_kmh").alias("speed_kmh"))


@query("w11_count_shots", f"WITH {RALLIES}, {SHOTS} SELECT session_id, rally, shots FROM sh")
def _(spark, sf):
    return M.count_shots(rallies(spark, sf))


@query("w8_w9_w10_t2_report_bounces", f"WITH RECURSIVE {RALLIES}, {SHOTS}, {BOUNCES} SELECT session_id, rally, frame, ROUND(z, 6) AS z FROM bo")
def _(spark, sf):
    rows = cut_lineage(rallies(spark, sf))
    return B.report_bounces(rows, M.count_shots(rows)).select("session_id", "rally", "frame", r("z").alias("z"))


@query("rally_summary", f"""WITH RECURSIVE {RALLIES}, {SPEEDS}, {SHOTS}, {BOUNCES},
jd AS (SELECT session_id, rally, COUNT(*) AS bounces,
   COUNT(*) FILTER (NOT (ABS(y) < 1.5 OR ABS(x) > 4.115 OR ABS(y) > 11.885)) AS bounces_in FROM bo GROUP BY session_id, rally),
base AS (SELECT session_id, rally, COUNT(*) AS n, MAX(t) - MIN(t) AS dur FROM rr GROUP BY session_id, rally),
av AS (SELECT session_id, rally, AVG(speed_kmh) AS a, MAX(speed_kmh) AS m FROM sp GROUP BY session_id, rally)
SELECT base.session_id, base.rally, n AS points, ROUND(dur, 6) AS duration_s, COALESCE(shots, 0) AS shots,
  ROUND(COALESCE(a, 0), 6) AS speed_avg, ROUND(COALESCE(m, 0), 6) AS speed_max,
  COALESCE(bounces, 0) AS bounces, COALESCE(bounces_in, 0) AS bounces_in
FROM base LEFT JOIN av USING (session_id, rally) LEFT JOIN sh USING (session_id, rally) LEFT JOIN jd USING (session_id, rally)""")
def rally_summary(spark, sf, name="points"):
    rows = cut_lineage(rallies(spark, sf, name))  # read by four branches below
    key = ["session_id", "rally"]
    base = rows.groupBy(*key).agg(F.count("*").alias("points"), (F.max("t") - F.min("t")).alias("duration_s"))
    speed = M.frame_speeds(rows).groupBy(*key).agg(F.avg("speed_kmh").alias("speed_avg"), F.max("speed_kmh").alias("speed_max"))
    shots = M.count_shots(rows)
    land = judge_landings(B.report_bounces(rows, shots)).groupBy(*key).agg(
        F.count("*").alias("bounces"), F.count_if(~F.col("is_out")).alias("bounces_in"))
    out = base.join(speed, key, "left").join(shots, key, "left").join(land, key, "left")
    return out.select(*key, "points", r("duration_s").alias("duration_s"), F.coalesce("shots", F.lit(0)).alias("shots"),
                      *[r(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("speed_avg", "speed_max")],
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bounces", "bounces_in")])


@query("w4_w5_clean_detections", """
WITH a AS (SELECT * FROM det WHERE blob_sum >= 3 AND ABS(world_x) <= 9.115 AND ABS(world_y) <= 16.885),
b AS (SELECT *, frame - LAG(frame) OVER w AS gap,
  SQRT((world_x-LAG(world_x) OVER w)*(world_x-LAG(world_x) OVER w) + (world_y-LAG(world_y) OVER w)*(world_y-LAG(world_y) OVER w)) AS d
  FROM a WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame)),
c AS (SELECT * FROM b WHERE gap IS NULL OR gap <= 0 OR d / gap <= 30.0 / 25),
e AS (SELECT *, LAG(frame) OVER w AS pf, LEAD(frame) OVER w AS nf FROM c WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame))
SELECT session_id, camera, frame FROM e WHERE COALESCE(frame - pf <= 10, FALSE) OR COALESCE(nf - frame <= 10, FALSE)""")
def _(spark, sf):
    return M.clean_detections(table(spark, sf, "det"), max_speed=30.0).select("session_id", "camera", "frame")


@query("w7_speed_profile", """
WITH a AS (SELECT *, frame - LAG(frame) OVER w AS gap,
   SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w) + (y-LAG(y) OVER w)*(y-LAG(y) OVER w) + (z-LAG(z) OVER w)*(z-LAG(z) OVER w)) AS d
   FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, frame, ROUND(d / (gap / 25.0) * 3.6, 6) AS speed_kmh FROM a WHERE gap BETWEEN 1 AND 5 AND d / (gap / 25.0) * 3.6 < 300""")
def _(spark, sf):
    return M.speed_profile(table(spark, sf, "points")).select("session_id", "frame", r("speed_kmh").alias("speed_kmh"))


@query("w26_net_crossings", """
WITH RECURSIVE a AS (SELECT session_id, frame, x, y, z, LAG(y) OVER w AS py,
   COUNT(*) OVER (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS nb,
   COUNT(*) OVER (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS na,
   COUNT(*) OVER e AS n, FIRST_VALUE(frame) OVER e AS f0, LAST_VALUE(frame) OVER e AS f1,
   FIRST_VALUE(x) OVER e AS x0, LAST_VALUE(x) OVER e AS x1, FIRST_VALUE(y) OVER e AS y0, LAST_VALUE(y) OVER e AS y1,
   FIRST_VALUE(z) OVER e AS z0, LAST_VALUE(z) OVER e AS z1
   FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame),
     e AS (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b AS (SELECT *, SQRT((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) / ((f1 - f0) / 25.0) * 3.6 AS v,
   CASE WHEN y > py THEN 'near_to_far' ELSE 'far_to_near' END AS dir FROM a
   WHERE ((py < 0 AND y >= 0) OR (y < 0 AND py >= 0)) AND nb >= 3 AND na >= 3 AND n >= 3 AND f1 > f0),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM b WHERE v BETWEEN 20 AND 250),
k AS (SELECT session_id, i, frame AS kf, v AS kv, dir AS kd, 1 AS grp FROM c WHERE i = 1
   UNION ALL SELECT c.session_id, c.i,
     CASE WHEN c.frame - k.kf >= 10 OR ABS(c.v - 100) < ABS(k.kv - 100) THEN c.frame ELSE k.kf END,
     CASE WHEN c.frame - k.kf >= 10 OR ABS(c.v - 100) < ABS(k.kv - 100) THEN c.v ELSE k.kv END,
     CASE WHEN c.frame - k.kf >= 10 OR ABS(c.v - 100) < ABS(k.kv - 100) THEN c.dir ELSE k.kd END,
     CASE WHEN c.frame - k.kf >= 10 THEN k.grp + 1 ELSE k.grp END
   FROM k JOIN c ON c.session_id = k.session_id AND c.i = k.i + 1),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, grp ORDER BY i DESC) AS q FROM k)
SELECT session_id, kf AS frame, ROUND(kv, 6) AS speed_kmh, kd AS direction FROM l WHERE q = 1""")
def _(spark, sf):
    return M.net_crossings(table(spark, sf, "points")).select("session_id", "frame", r("speed_kmh").alias("speed_kmh"), "direction")


@query("w27_crossing_speed_twopoint", """
WITH a AS (SELECT *, frame - LAG(frame) OVER w AS gap, LAG(y) OVER w AS py,
   SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w) + (y-LAG(y) OVER w)*(y-LAG(y) OVER w) + (z-LAG(z) OVER w)*(z-LAG(z) OVER w)) AS d
   FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, frame, ROUND(d / (gap / 25.0) * 3.6, 6) AS speed_kmh FROM a
WHERE gap <= 5 AND ((py < 0 AND y >= 0) OR (py >= 0 AND y < 0))""")
def _(spark, sf):
    return M.crossings_twopoint(table(spark, sf, "points")).select("session_id", "frame", r("speed_kmh").alias("speed_kmh"))


@query("w28_crossing_counts", """
WITH a AS (SELECT *, frame - LAG(frame) OVER w AS gap, LAG(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, COUNT(*) FILTER (gap <= 3 AND ((py < 0 AND y > 0) OR (py > 0 AND y < 0))) AS crossings FROM a GROUP BY session_id""")
def _(spark, sf):
    return M.crossing_counts(table(spark, sf, "points"))


@query("w56_block_consistency", """
WITH a AS (SELECT *, CAST(FLOOR(frame / 8.0) AS BIGINT) AS b FROM det),
c AS (SELECT *, frame - LAG(frame) OVER w AS gap,
  SQRT((pixel_x-LAG(pixel_x) OVER w)*(pixel_x-LAG(pixel_x) OVER w) + (pixel_y-LAG(pixel_y) OVER w)*(pixel_y-LAG(pixel_y) OVER w)) AS d
  FROM a WINDOW w AS (PARTITION BY session_id, camera, b ORDER BY frame)),
e AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id, camera, b) AS n,
  COUNT(*) FILTER (d < 60 * gap) OVER (PARTITION BY session_id, camera, b) AS s FROM c)
SELECT session_id, camera, frame FROM e WHERE n >= 4 AND s >= GREATEST(1, (n - 1) // 2)""")
def _(spark, sf):
    return M.block_consistency(table(spark, sf, "det"), jump=60.0).select("session_id", "camera", "frame")


@query("w52_resample", """
WITH a AS (SELECT *, CAST(FLOOR(frame / 4.0) AS BIGINT) AS bucket FROM points),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, bucket ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, frame) AS k FROM a)
SELECT session_id, bucket, frame, event_type, ROUND(x, 6) AS x FROM b WHERE k = 1""")
def _(spark, sf):
    return M.resample(table(spark, sf, "points"), 4, F.col("event_type") == "purchase").select(
        "session_id", "bucket", "frame", "event_type", r("x").alias("x"))
