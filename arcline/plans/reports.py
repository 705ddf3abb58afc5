"""Rally, report and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..court import in_court
from ..operators import bounce as B
from ..operators import motion as M
from ..operators import rally as R
from ..operators import report as RP
from ..operators import strokes as K
from ..operators.ordered import row_index
from ..operators.predicates import judge_landings
from ..session import cut_lineage
from .detection import SERVES
from .evaluation import rounded
from .fixtures import table
from .motion import BOUNCES, RALLIES, SHOTS, SPEEDS, rallies
from .registry import query, r

KEYS = ["session_id"]

WIN = """
p0 AS (SELECT session_id, frame, y, z, t - MIN(t) OVER (PARTITION BY session_id) AS rt FROM points),
p1 AS (SELECT *, MAX(rt) OVER (PARTITION BY session_id) AS dur FROM p0 WHERE TRUE),
w0 AS (SELECT p1.*, wi FROM p1, UNNEST(RANGE(GREATEST(CAST(FLOOR(rt / 0.5) AS BIGINT) - 9, 0), CAST(FLOOR(rt / 0.5) AS BIGINT) + 1)) u(wi) WHERE rt >= wi * 0.5 AND rt < wi * 0.5 + 5 AND wi * 0.5 + 5 <= dur + 0.5),
w1 AS (SELECT *, CASE WHEN COUNT(*) OVER f = 5 THEN AVG(y) OVER f END AS ys, rt - LAG(rt) OVER w AS gp, CASE WHEN z > 1 THEN 1 WHEN z < 0.5 THEN 0 END AS lv FROM w0
  WINDOW w AS (PARTITION BY session_id, wi ORDER BY rt), f AS (PARTITION BY session_id, wi ORDER BY rt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, ys - LAG(ys) OVER w AS dy, LAST_VALUE(lv IGNORE NULLS) OVER (PARTITION BY session_id, wi ORDER BY rt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM w1 WINDOW w AS (PARTITION BY session_id, wi ORDER BY rt)),
w3 AS (SELECT *, CASE WHEN ABS(dy) > 0.5 THEN SIGN(dy) END AS dir FROM w2),
w4 AS (SELECT *, LAST_VALUE(dir IGNORE NULLS) OVER (PARTITION BY session_id, wi ORDER BY rt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd FROM w3),
w5 AS (SELECT session_id, wi, COUNT(*) AS n, MIN(y) AS lo, MAX(y) AS hi, COUNT(*) FILTER (lv = 0 AND pl = 1) AS arcs, COUNT(*) FILTER (dir <> pd) AS turns, COUNT(*) FILTER (gp > 0.3) / GREATEST(COUNT(*) - 1, 1) AS gaps FROM w4 GROUP BY session_id, wi),
w6 AS (SELECT session_id, wi, CASE WHEN lo < -2 AND hi > 2 THEN 2 ELSE 0 END + CASE WHEN hi - lo > 15 THEN 3 ELSE 0 END + LEAST(arcs * 2, 10) + CASE WHEN n > 10 THEN LEAST(turns, 8) ELSE 0 END + CASE WHEN gaps < 0.1 THEN 2 ELSE 0 END AS score FROM w5 WHERE n >= 5),
w7 AS (SELECT *, CASE WHEN wi - LAG(wi) OVER (PARTITION BY session_id ORDER BY wi) <= 6 THEN 0 ELSE 1 END AS b FROM w6 WHERE score >= 12),
w8 AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY wi) AS g FROM w7),
sr AS (SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY MIN(wi)) AS rally, MIN(wi) * 0.5 AS start_s, MAX(wi) * 0.5 + 5 AS end_s, MAX(score) AS peak_score FROM w8 GROUP BY session_id, g HAVING MAX(wi) * 0.5 + 5 - MIN(wi) * 0.5 >= 2)"""


def first_ts(points):
    return points.groupBy("session_id").agg(F.min("t").alias("t0"))


@query("w12_scored_rallies", f"WITH {WIN} SELECT session_id, rally, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, peak_score FROM sr")
def _(spark, sf):
    p = table(spark, sf, "points")
    return R.scored_rallies(p, first_ts(p)).withColumns({c: F.col(c).cast("double") for c in ("start_s", "end_s")})


@query("x6_crossing_rallies", """
WITH c AS (SELECT p.*, LAG(y) OVER w AS py, CASE WHEN frame - LAG(frame) OVER w <= 75 THEN 0 ELSE 1 END AS b FROM points p WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g, COALESCE((py < 0 AND y >= 0) OR (py >= 0 AND y < 0), FALSE) AS cr FROM c),
f AS (SELECT *, MIN(CASE WHEN cr THEN frame END) OVER (PARTITION BY session_id, g) AS st FROM s)
SELECT f.session_id, ROW_NUMBER() OVER (PARTITION BY f.session_id ORDER BY st) AS rally, st AS start_frame, MAX(f.frame) AS end_frame, COUNT(*) FILTER (cr) AS strokes, COUNT(e.frame) AS bounces, ROUND(MAX(f.t) - MIN(f.t), 6) AS duration_s
FROM f LEFT JOIN gt_events e ON e.session_id = f.session_id AND e.frame = f.frame WHERE f.frame >= st GROUP BY f.session_id, st""")
def _(spark, sf):
    return rounded(R.crossing_rallies(table(spark, sf, "points"), table(spark, sf, "gt_events")), "duration_s", n=6)


def judged_events(spark, sf):
    g = table(spark, sf, "gt_events")
    return g.withColumns({"in_court": in_court(F.col("x"), F.col("y")), "side": F.when(F.col("y") < 0, "near").otherwise("far")})


@query("x7_points_played")
def _(spark, sf):
    t = R.points_played(table(spark, sf, "points"), judged_events(spark, sf))
    return t.select("session_id", "rally", "start_frame", "end_frame", "strokes", "bounces", "reason", "end_side", "server")


@query("w31_frame_rallies")
def _(spark, sf):
    d = table(spark, sf, "det66")
    return R.frame_rallies(d, judged_events(spark, sf), K.serves(d, gap=7))


@query("w16_v_shape_bounces")
def _(spark, sf):
    return rounded(R.v_shape_bounces(table(spark, sf, "points")), "x", "y", "z", "confidence")


LAND = """
la AS (SELECT p.session_id, p.frame, p.x, p.y, a.blob_sum AS ca, a.world_x AS ax, a.world_y AS ay, b.blob_sum AS cb, b.world_x AS bx, b.world_y AS by_ FROM points p
  LEFT JOIN det66 a ON a.session_id = p.session_id AND a.frame = p.frame LEFT JOIN det68 b ON b.session_id = p.session_id AND b.frame = p.frame),
lb AS (SELECT *, COUNT(ax) OVER p + COUNT(ax) OVER q + COUNT(bx) OVER p + COUNT(bx) OVER q AS n, COALESCE(SUM(ax) OVER p, 0) + COALESCE(SUM(bx) OVER p, 0) + COALESCE(SUM(ax) OVER q, 0) + COALESCE(SUM(bx) OVER q, 0) AS sx FROM la
  WINDOW p AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""


@query("m3_landing_positions", f"""WITH {LAND} SELECT session_id, frame, CASE WHEN ca IS NOT NULL AND (cb IS NULL OR ca >= cb) THEN 'cam66' WHEN cb IS NOT NULL THEN 'cam68' WHEN n > 0 THEN 'interpolated' ELSE '3d' END AS source,
  ROUND(CASE WHEN ca IS NOT NULL AND (cb IS NULL OR ca >= cb) THEN ax WHEN cb IS NOT NULL THEN bx WHEN n > 0 THEN sx / n ELSE x END, 5) AS land_x FROM lb""")
def _(spark, sf):
    d = table(spark, sf, "det")
    t = R.landing_positions(table(spark, sf, "points"), d.where("camera = 'cam66'"), d.where("camera = 'cam68'"))
    return t.select("session_id", "frame", "source", r("land_x", 5).alias("land_x"))


@query("w17_dip_bounces", f"""WITH RECURSIVE {LAND.strip()},
ld AS (SELECT session_id, frame, CASE WHEN ca IS NOT NULL AND (cb IS NULL OR ca >= cb) THEN 'cam66' WHEN cb IS NOT NULL THEN 'cam68' WHEN n > 0 THEN 'interpolated' ELSE '3d' END AS source,
  CASE WHEN ca IS NOT NULL AND (cb IS NULL OR ca >= cb) THEN ax WHEN cb IS NOT NULL THEN bx WHEN n > 0 THEN sx / n ELSE x END AS land_x,
  CASE WHEN ca IS NOT NULL AND (cb IS NULL OR ca >= cb) THEN ay WHEN cb IS NOT NULL THEN by_ WHEN n > 0 THEN sy / n ELSE y END AS land_y FROM (
    SELECT *, COALESCE(SUM(ay) OVER p, 0) + COALESCE(SUM(by_) OVER p, 0) + COALESCE(SUM(ay) OVER q, 0) + COALESCE(SUM(by_) OVER q, 0) AS sy FROM lb
    WINDOW p AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) u),
q AS (SELECT session_id, frame, z, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM points),
s AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST([] AS STRUCT(f BIGINT, z DOUBLE)[]) AS w, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS conf FROM q
  UNION ALL SELECT session_id, i, frame, CASE WHEN yes THEN w[k + 1:] ELSE w END, CASE WHEN yes THEN frame ELSE seen END, CASE WHEN yes THEN w[k].f END, CASE WHEN yes THEN w[k].z END,
    CASE WHEN yes THEN ROUND_EVEN(LEAST(1.0, 0.7 * LEAST(1.0, LEAST(w[k - 2].z, w[LEAST(LEN(w), k + 2)].z) - w[k].z) + 0.3 * LEAST(1.0, LEN(w) / 6.0)), 3) END FROM (
    SELECT *, COALESCE(NOT wait AND k IS NOT NULL AND w[k].z <= 0.8 AND w[k].z <= LEAST(w[k - 2].z, w[k + 1].z) - 0.1, FALSE) AS yes FROM (
      SELECT *, LEN(w) < 4 OR COALESCE(frame - seen < 5, FALSE) AS wait, LIST_SORT(LIST_TRANSFORM(LIST_FILTER(RANGE(3, LEN(w)), lambda m: w[m - 2].z >= w[m - 1].z - 0.15 AND w[m - 1].z >= w[m].z - 0.15 AND w[m].z <= w[m + 1].z + 0.15),
        lambda m: {{'z': w[m].z, 'm': m}}))[1].m AS k FROM (
        SELECT q.session_id, q.i, q.frame, s.seen, LIST_APPEND(s.w, {{'f': q.frame, 'z': q.z}})[-8:] AS w FROM s JOIN q ON q.session_id = s.session_id AND q.i = s.i + 1) a) b) c)
SELECT s.session_id, hit AS frame, s.frame AS seen_at, ROUND(land_x, 5) AS x, ROUND(land_y, 5) AS y, ROUND(low, 5) AS z, conf AS confidence, source FROM s JOIN ld ON ld.session_id = s.session_id AND ld.frame = s.hit WHERE hit IS NOT NULL""")
def _(spark, sf):
    p, d = table(spark, sf, "points"), table(spark, sf, "det")
    land = R.landing_positions(p, d.where("camera = 'cam66'"), d.where("camera = 'cam68'"))
    return rounded(R.dip_bounces(p, land), "x", "y", "z")


@query("w22_single_camera_bounces")
def _(spark, sf):
    return rounded(R.single_camera_bounces(table(spark, sf, "det")), "x", "y")


_W55 = """WITH RECURSIVE q AS (SELECT session_id, frame, t, x, y, CASE WHEN y < 0 THEN 'near' ELSE 'far' END AS half, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM gt_events),
s AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST([] AS STRUCT(t DOUBLE, x DOUBLE, y DOUBLE, half VARCHAR)[]) AS acc, CAST(NULL AS VARCHAR) AS verdict FROM q
  UNION ALL SELECT session_id, i, frame, CASE WHEN verdict = 'accepted' THEN LIST_APPEND(acc, {'t': t, 'x': x, 'y': y, 'half': half})[-5:] ELSE acc END, verdict FROM (
    SELECT q.*, s.acc, CASE WHEN LEN(LIST_FILTER(s.acc, lambda p: q.t - p.t BETWEEN 0 AND 0.7 AND SQRT((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 1)) > 0 THEN 'duplicate'
      WHEN q.t - s.acc[-1].t >= 0 AND q.t - s.acc[-1].t < 0.4 AND s.acc[-1].half = q.half AND SQRT((q.x - s.acc[-1].x) * (q.x - s.acc[-1].x) + (q.y - s.acc[-1].y) * (q.y - s.acc[-1].y)) < 2 THEN 'f2_min_interval' ELSE 'accepted' END AS verdict
    FROM s JOIN q ON q.session_id = s.session_id AND q.i = s.i + 1) a)
"""


@query("w55_accepted_bounces", _W55 + "SELECT session_id, frame, verdict FROM s WHERE verdict IS NOT NULL")
def _(spark, sf):
    return R.accepted_bounces(table(spark, sf, "gt_events"))


@query("a31_filter_reasons", _W55 + "SELECT session_id, verdict, COUNT(*) AS n FROM s WHERE verdict IS NOT NULL GROUP BY session_id, verdict")
def _(spark, sf):
    return R.accepted_bounces(table(spark, sf, "gt_events")).groupBy("session_id", "verdict").agg(F.count("*").alias("n"))


@query("a3_p16_speed_bands", f"""WITH {RALLIES}, {SPEEDS},
b AS (SELECT session_id, 'tier' AS kind, u.label, COUNT(*) FILTER (speed_kmh >= u.lo AND speed_kmh < u.hi) AS n FROM sp CROSS JOIN (VALUES ('Slow', -1e9, 40), ('Medium', 40, 65), ('Fast', 65, 90), ('Power', 90, 115), ('Max', 115, 1e9)) u(label, lo, hi) GROUP BY 1, 2, 3
  UNION ALL SELECT session_id, 'bin', (20 + 10 * k) || '-' || (30 + 10 * k), COUNT(*) FILTER (LEAST(CAST(FLOOR((speed_kmh - 20) / 10) AS BIGINT), 12) = k) FROM sp CROSS JOIN (SELECT UNNEST(RANGE(13)) AS k) u GROUP BY 1, 2, 3)
SELECT * FROM b""")
def _(spark, sf):
    return RP.speed_bands(M.frame_speeds(rallies(spark, sf)), KEYS)


@query("a1_match_summary", f"""WITH RECURSIVE {RALLIES}, {SPEEDS}, {SHOTS}, {BOUNCES},
j AS (SELECT session_id, COUNT(*) AS total_bounces, COUNT(*) FILTER (NOT o) AS bounces_in, COUNT(*) FILTER (o) AS bounces_out, COUNT(*) FILTER (y < 0) AS near_total, COUNT(*) FILTER (y < 0 AND NOT o) AS near_in, COUNT(*) FILTER (y >= 0) AS far_total, COUNT(*) FILTER (y >= 0 AND NOT o) AS far_in
  FROM (SELECT *, ABS(y) < 1.5 OR ABS(x) > 4.115 OR ABS(y) > 11.885 AS o FROM bo) GROUP BY session_id),
a AS (SELECT session_id, COUNT(*) AS total_frames FROM points GROUP BY session_id),
e AS (SELECT session_id, COUNT(*) AS rally_count, SUM(n)::BIGINT AS rally_frames, SUM(d) AS play_s FROM (SELECT session_id, rally, COUNT(*) AS n, MAX(t) - MIN(t) AS d FROM rr GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT session_id, SUM(shots)::BIGINT AS total_shots FROM sh GROUP BY 1), v AS (SELECT session_id, AVG(speed_kmh) AS avg_speed, MAX(speed_kmh) AS max_speed FROM sp GROUP BY 1)
SELECT a.session_id, total_frames, COALESCE(rally_count, 0) AS rally_count, COALESCE(rally_frames, 0) AS rally_frames, ROUND(COALESCE(play_s, 0), 5) AS play_s, COALESCE(total_shots, 0) AS total_shots, ROUND(COALESCE(avg_speed, 0), 5) AS avg_speed, ROUND(COALESCE(max_speed, 0), 5) AS max_speed,
  COALESCE(total_bounces, 0) AS total_bounces, COALESCE(bounces_in, 0) AS bounces_in, COALESCE(bounces_out, 0) AS bounces_out, COALESCE(near_total, 0) AS near_total, COALESCE(near_in, 0) AS near_in, COALESCE(far_total, 0) AS far_total, COALESCE(far_in, 0) AS far_in
FROM a LEFT JOIN e USING (session_id) LEFT JOIN s USING (session_id) LEFT JOIN v USING (session_id) LEFT JOIN j USING (session_id)""")
def _(spark, sf):
    rows = cut_lineage(rallies(spark, sf))
    shots = M.count_shots(rows)
    s = RP.match_summary(table(spark, sf, "points"), rows, M.frame_speeds(rows), shots, judge_landings(B.report_bounces(rows, shots)))
    return rounded(s, "play_s", "avg_speed", "max_speed")


def _movement(side):
    x, y = f"{side}_x", f"{side}_y"

    @query(f"a4_player_movement_{side}", f"""WITH a AS (SELECT *, ts - LAG(ts) OVER w AS dt, SQRT(({x}-LAG({x}) OVER w)*({x}-LAG({x}) OVER w) + ({y}-LAG({y}) OVER w)*({y}-LAG({y}) OVER w)) AS d FROM play WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, '{side}' AS side, ROUND(COALESCE(SUM(d) FILTER (d BETWEEN 0.05 AND 0.5), 0), 5) AS distance, ROUND(COALESCE(MAX(LEAST(d / dt, 7)) FILTER (d BETWEEN 0.05 AND 0.5 AND dt > 0.001), 0), 5) AS max_speed,
  ROUND(COALESCE(SUM(d) FILTER (d BETWEEN 0.05 AND 0.5), 0) / (MAX(ts) - MIN(ts)), 5) AS avg_speed FROM a GROUP BY session_id""")
    def _(spark, sf):
        return rounded(RP.player_movement(table(spark, sf, "play"), side), "distance", "max_speed", "avg_speed")


_movement("near")
_movement("far")


@query("a5_ball_speed", "SELECT session_id, ROUND(AVG(speed_kmh), 5) AS avg_speed, ROUND(MAX(speed_kmh), 5) AS max_speed FROM play WHERE (is_hit OR is_bounce) AND speed_kmh BETWEEN 50 AND 150 GROUP BY session_id")
def _(spark, sf):
    t = table(spark, sf, "play").where((F.col("is_hit") | F.col("is_bounce")) & F.col("speed_kmh").between(50, 150))
    return rounded(t.groupBy(*KEYS).agg(F.avg("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed")), "avg_speed", "max_speed")


def play_with_hands(spark, sf):
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    kp = F.concat(F.array_repeat(zero, 6), F.array(F.array("shoulder_x", F.lit(0.0), F.lit(0.9))), F.array_repeat(zero, 3), F.array(F.array("wrist_x", F.lit(0.0), "wrist_conf")))
    return table(spark, sf, "play").withColumn("keypoints", kp)


RM = """
m0 AS (SELECT *, ROUND(LEAST(GREATEST((x + 4.115) / 8.23, 0), 1), 4) AS nx, ROUND(LEAST(GREATEST((y + 11.885) / 23.77, 0), 1), 4) AS ny FROM play WHERE is_bounce OR is_hit),
m1 AS (SELECT * FROM m0 WHERE nx > 0 AND nx < 1 AND ny > 0 AND ny < 1 AND (is_bounce OR speed_kmh >= 50)),
m2 AS (SELECT *, MIN(CASE WHEN NOT is_bounce AND ny < 0.5 THEN frame END) OVER (PARTITION BY session_id) AS sf FROM m1),
rm AS (SELECT session_id, frame, nx, ny, CASE WHEN is_bounce THEN 'bounce' WHEN frame = sf THEN 'serve' ELSE 'hit' END AS kind, CAST(ROUND_EVEN(ROUND(LEAST(GREATEST(speed_kmh, 50), 150), 1), 0) AS BIGINT) AS speed,
  CASE WHEN NOT is_bounce AND wrist_conf >= 0.3 AND shoulder_x > wrist_x THEN 'backhand' ELSE 'forehand' END AS hand FROM m2)"""


@query("w48_result_matrix", f"WITH {RM} SELECT * FROM rm")
def _(spark, sf):
    return RP.result_matrix(play_with_hands(spark, sf))


@query("a6_hand_rates", f"WITH {RM} SELECT session_id, ROUND(100 * AVG(CASE WHEN hand = 'forehand' THEN 1.0 ELSE 0 END), 5) AS forehand_pct, ROUND(100 * AVG(CASE WHEN hand = 'backhand' THEN 1.0 ELSE 0 END), 5) AS backhand_pct FROM rm WHERE kind <> 'bounce' GROUP BY session_id")
def _(spark, sf):
    t = RP.result_matrix(play_with_hands(spark, sf)).where("kind <> 'bounce'")
    return rounded(t.groupBy(*KEYS).agg(*[(100 * F.avg((F.col("hand") == h).cast("double"))).alias(f"{h}_pct") for h in ("forehand", "backhand")]), "forehand_pct", "backhand_pct")


def _side_stats(side):
    mine = "ny < 0.5" if side == "near" else "ny >= 0.5"
    box = "b.ny BETWEEN 0.6 AND 0.9" if side == "near" else "b.ny BETWEEN 0.1 AND 0.4"
    deep = "ny" if side == "far" else "1 - ny"
    opp = "r.ny >= 0.5" if side == "near" else "r.ny < 0.5"

    @query(f"a7_side_statistics_{side}", f"""WITH {RM},
n AS (SELECT rm.*, kind <> 'bounce' AND {mine} AS ms, kind <> 'bounce' AND NOT ({mine}) AS os, (SELECT MIN(q.frame) FROM rm q WHERE q.session_id = rm.session_id AND q.frame > rm.frame AND q.kind = 'bounce') AS bf FROM rm),
o AS (SELECT n.*, (SELECT MIN(q.frame) FROM n q WHERE q.session_id = n.session_id AND q.frame > n.frame AND q.ms) AS mf, (SELECT MIN(q.frame) FROM n q WHERE q.session_id = n.session_id AND q.frame > n.frame AND q.os) AS of_,
  (SELECT MIN(q.frame) FROM n q WHERE q.session_id = n.session_id AND q.frame > n.frame AND q.kind = 'serve') AS sf FROM n),
p AS (SELECT o.*, COALESCE({box} AND b.nx BETWEEN 0.15 AND 0.85, FALSE) AS ib, COALESCE({opp}, FALSE) AS ret FROM o LEFT JOIN rm b ON b.session_id = o.session_id AND b.frame = o.bf
  LEFT JOIN n m ON m.session_id = o.session_id AND m.frame = o.mf LEFT JOIN rm r ON r.session_id = o.session_id AND r.frame = m.bf),
s AS (SELECT session_id, COUNT(*) FILTER (ms) AS total_shots, COUNT(*) FILTER (kind = 'serve' AND ms) AS serves, COUNT(*) FILTER (kind = 'serve' AND ib) AS serves_in, COUNT(*) FILTER (kind = 'serve' AND os) AS received, COUNT(*) FILTER (kind = 'serve' AND os AND ret) AS returned,
  COUNT(*) FILTER (ms AND {deep} >= 0.8) AS baseline_hits, COUNT(*) FILTER (ms AND {deep} <= 0.2) AS net_hits, COUNT(*) FILTER (kind = 'serve' AND ms AND ib AND (of_ IS NULL OR of_ > sf)) AS aces, AVG(speed) FILTER (ms AND speed BETWEEN 50 AND 150) AS avg_speed FROM p GROUP BY session_id)
SELECT session_id, '{side}' AS side, total_shots, serves, serves_in, received, returned, baseline_hits, net_hits, aces, ROUND(avg_speed, 5) AS avg_speed, ROUND(CASE WHEN serves > 0 THEN 100 * serves_in / serves ELSE 0 END, 5) AS first_serve_pct,
  ROUND(CASE WHEN received > 0 THEN 100 * returned / received ELSE 0 END, 5) AS return_pct, ROUND(CASE WHEN total_shots > 0 THEN 100 * baseline_hits / total_shots ELSE 0 END, 5) AS baseline_pct, ROUND(CASE WHEN total_shots > 0 THEN 100 * net_hits / total_shots ELSE 0 END, 5) AS net_pct FROM s""")
    def _(spark, sf):
        t = RP.side_statistics(RP.result_matrix(play_with_hands(spark, sf)), side)
        return rounded(t, "avg_speed", "first_serve_pct", "return_pct", "baseline_pct", "net_pct")


_side_stats("near")
_side_stats("far")

TM = """
t0 AS (SELECT *, CASE WHEN near_x IS NOT NULL THEN ROUND(LEAST(GREATEST((near_x + 4.115) / 8.23, 0), 1), 4) END AS qx, CASE WHEN far_y IS NOT NULL THEN ROUND(LEAST(GREATEST((far_y + 11.885) / 23.77, 0), 1), 4) END AS qy FROM play),
tm AS (SELECT session_id, frame, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS timestamp, CASE WHEN is_bounce THEN 'bounce' WHEN is_hit THEN 'hit' ELSE 'running' END AS state,
  COALESCE(LAST_VALUE(qx IGNORE NULLS) OVER w, 0.5) AS near_xn, COALESCE(LAST_VALUE(qy IGNORE NULLS) OVER w, 0.05) AS far_yn FROM t0 WINDOW w AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("w47_track_matrix", f"WITH {TM} SELECT * FROM tm")
def _(spark, sf):
    return RP.track_matrix(table(spark, sf, "play")).select("session_id", "frame", "timestamp", "state", "near_xn", "far_yn")


@query("t4_thinned_track", f"""WITH {TM}, n AS (SELECT session_id, COUNT(*) AS n FROM tm GROUP BY session_id),
s AS (SELECT session_id, n, UNNEST(RANGE(LEAST(n, 300))) AS slot FROM n), i AS (SELECT session_id, slot, CASE WHEN n <= 300 THEN slot ELSE CAST(ROUND_EVEN(slot * (CAST(n - 1 AS DOUBLE) / 299), 0) AS BIGINT) END AS ix FROM s)
SELECT i.session_id, slot AS timestamp, tm.frame, state FROM i JOIN tm ON tm.session_id = i.session_id AND tm.timestamp = i.ix""")
def _(spark, sf):
    t = RP.thin_evenly(RP.track_matrix(table(spark, sf, "play")), KEYS, "timestamp", 300)
    return t.select("session_id", F.col("timestamp").cast("long").alias("timestamp"), "frame", "state")


@query("s19_display_feed", f"""WITH {RALLIES},
c AS (SELECT session_id, frame, d / (gap / 25.0) * 3.6 AS v FROM (SELECT *, frame - LAG(frame) OVER w AS gap, LAG(y) OVER w AS py, SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w) + (y-LAG(y) OVER w)*(y-LAG(y) OVER w) + (z-LAG(z) OVER w)*(z-LAG(z) OVER w)) AS d
  FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)) WHERE gap <= 5 AND ((py < 0 AND y >= 0) OR (py >= 0 AND y < 0))),
s AS (SELECT session_id, UNNEST(RANGE(MIN(frame), MAX(frame) + 1)) AS frame FROM points GROUP BY session_id),
k AS (SELECT s.*, CASE WHEN g.frame IS NOT NULL THEN 'bounce' WHEN c.frame IS NOT NULL THEN 'net_crossing' WHEN rr.frame IS NOT NULL THEN 'rally' ELSE 'none' END AS kind FROM s LEFT JOIN gt_events g ON g.session_id = s.session_id AND g.frame = s.frame
  LEFT JOIN c ON c.session_id = s.session_id AND c.frame = s.frame LEFT JOIN rr ON rr.session_id = s.session_id AND rr.frame = s.frame)
SELECT session_id, frame, kind, ROUND(CASE WHEN kind = 'bounce' THEN (SELECT ARG_MAX(c.v, c.frame) FROM c WHERE c.session_id = k.session_id AND c.frame <= k.frame) END, 5) AS speed FROM k""")
def _(spark, sf):
    t = RP.display_feed(table(spark, sf, "points"), table(spark, sf, "gt_events"), M.crossings_twopoint(table(spark, sf, "points")), rallies(spark, sf))
    return t.withColumn("speed", r("speed", 5))


@query("a27_feature_profile", """
WITH a AS (SELECT *, (frame - LAG(frame) OVER w) / 25.0 AS dt, LAG(y) OVER w AS py, x - LAG(x) OVER w AS dx, y - LAG(y) OVER w AS dy, z - LAG(z) OVER w AS dz FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
b AS (SELECT *, CASE WHEN dt <= 0.12 THEN SQRT(POW(dx/dt,2)+POW(dy/dt,2)+POW(dz/dt,2)) END AS v0, CASE WHEN dt <= 0.12 THEN SQRT(POW(dx/dt,2)+POW(dy/dt,2)) END AS h0 FROM a),
c AS (SELECT *, CASE WHEN v0 > 1 AND v0 < 80 THEN v0 END AS v, CASE WHEN h0 > 1 AND h0 < 80 THEN h0 END AS h, CASE WHEN ((py < 0 AND y > 0) OR (py > 0 AND y < 0)) AND v0 > 5 AND v0 < 80 THEN v0 END AS cv FROM b),
s AS (SELECT session_id, AVG(v) AS speed_mean, STDDEV_POP(v) AS speed_std, AVG(z) AS height_mean, STDDEV_POP(z) AS height_std, MAX(z) AS height_max, AVG(cv) AS cross_speed_mean, COUNT(cv) AS cross_count, AVG(h) AS h_speed_mean, STDDEV_POP(h) AS h_speed_std,
  QUANTILE_CONT(v, 0.5) AS speed_median, QUANTILE_CONT(v, 0.9) AS speed_p90 FROM c GROUP BY session_id),
g AS (SELECT *, LEAD(frame) OVER (PARTITION BY session_id ORDER BY frame) AS nf FROM gt_events),
l AS (SELECT session_id, COUNT(*) AS bounce_count, AVG(z) AS bounce_z_mean, AVG(x) AS land_x_mean, STDDEV_POP(x) AS land_x_std, AVG((nf - frame) / 25.0) FILTER (nf - frame < 100) AS interval_mean FROM g GROUP BY session_id),
r AS (SELECT session_id, AVG(top) AS arc_mean FROM (SELECT g.session_id, g.frame, MAX(p.z) AS top FROM g JOIN points p ON p.session_id = g.session_id AND p.frame BETWEEN g.frame AND g.nf GROUP BY 1, 2) GROUP BY 1)
SELECT session_id, cross_count, bounce_count, """ + ", ".join(f"ROUND({c}, 5) AS {c}" for c in "speed_mean speed_std height_mean height_std height_max cross_speed_mean h_speed_mean h_speed_std speed_median speed_p90 bounce_z_mean land_x_mean land_x_std interval_mean arc_mean".split()) + " FROM s JOIN l USING (session_id) JOIN r USING (session_id)")
def _(spark, sf):
    t = RP.feature_profile(table(spark, sf, "points"), table(spark, sf, "gt_events"))
    return rounded(t, *[c for c in t.columns if c not in ("session_id", "cross_count", "bounce_count")])


@query("t5_recent_rows", "SELECT session_id, frame FROM points QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame DESC) <= 50")
def _(spark, sf):
    return RP.latest_rows(table(spark, sf, "points"), KEYS, "frame", 50).select("session_id", "frame")


@query("t6_primary_rally", f"WITH {RALLIES}, c AS (SELECT session_id, rally, COUNT(*) AS n FROM rr GROUP BY 1, 2) SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY n DESC, rally) = 1")
def _(spark, sf):
    c = rallies(spark, sf).groupBy("session_id", "rally").agg(F.count("*").alias("n"))
    return c.groupBy("session_id").agg(F.max_by(F.struct("rally", "n"), F.struct("n", -F.col("rally"))).alias("b")).select("session_id", "b.*")


@query("t3_trajectory_samples", f"""WITH {RALLIES}, i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, rally ORDER BY frame) - 1 AS i, COUNT(*) OVER (PARTITION BY session_id, rally) AS n FROM rr),
s AS (SELECT * FROM i WHERE n >= 5 AND i % GREATEST(1, n // 100) = 0), k AS (SELECT session_id, rally, COUNT(*) AS c FROM s GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY COUNT(*) DESC, rally) <= 8)
SELECT s.session_id, s.rally, s.frame FROM s JOIN k USING (session_id, rally)""")
def _(spark, sf):
    from pyspark.sql import Window

    key = ["session_id", "rally"]
    rows = row_index(rallies(spark, sf), key, "frame")
    n = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 5")
    s = rows.join(n, key).where(F.col("idx") % F.greatest(F.lit(1), F.floor(F.col("n") / 100)) == 0)
    top = s.groupBy(*key).agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("c"), "rally"))).where("k <= 8")
    return s.join(top.select(*key), key, "left_semi").select("session_id", "rally", "frame")


@query("a32_latest_detection", "SELECT session_id, camera, frame, ROUND(pixel_x, 5) AS px FROM det QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, camera ORDER BY ts DESC) = 1")
def _(spark, sf):
    t = table(spark, sf, "det").groupBy("session_id", "camera").agg(F.max_by(F.struct("frame", F.col("pixel_x").alias("px")), "ts").alias("l"))
    return t.select("session_id", "camera", "l.frame", r("l.px", 5).alias("px"))
