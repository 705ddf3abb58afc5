"""Arc fitting, tracks and best-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import bounce as B
from ..operators import fit as FT
from ..operators import motion as M
from ..operators import tracks as TR
from ..session import cut_lineage
from .evaluation import rounded
from .fixtures import CAM_A, CAM_B, table
from .joins import pairs
from .motion import RALLIES, rallies
from .registry import query, r

KEY = ["session_id", "rally"]


def fit_sql(src, by, name="ft", min_rows=3):
    b = ", ".join(by)
    s = [f"s{k}" for k in range(5)]
    det = "(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"
    return f"""
{name}c AS (SELECT *, y - AVG(y) OVER (PARTITION BY {b}) AS u, AVG(y) OVER (PARTITION BY {b}) AS my, 1 / GREATEST(ray_dist, 0.01) AS w FROM {src}),
{name}s AS (SELECT {b}, MIN(my) AS m, COUNT(*) AS n, MIN(y) AS y_min, MAX(y) AS y_max, ARG_MIN(y, frame) AS y_first, {', '.join(f'SUM(w*POW(u,{k})) AS s{k}' for k in range(5))}, {', '.join(f'SUM(w*POW(u,{k})*z) AS z{k}' for k in range(3))}, {', '.join(f'SUM(w*POW(u,{k})*x) AS x{k}' for k in range(2))}
  FROM {name}c GROUP BY {b} HAVING COUNT(*) >= {min_rows}),
{name}d AS (SELECT *, (z0*(s2*s4-s3*s3) - s1*(z1*s4-s3*z2) + s2*(z1*s3-s2*z2))/{det} AS c0, (s0*(z1*s4-z2*s3) - z0*(s1*s4-s2*s3) + s2*(s1*z2-z1*s2))/{det} AS c1, (s0*(s2*z2-s3*z1) - s1*(s1*z2-s2*z1) + z0*(s1*s3-s2*s2))/{det} AS az,
  (s0*x1-s1*x0)/(s0*s2-s1*s1) AS ax, (s2*x0-s1*x1)/(s0*s2-s1*s1) AS xc FROM {name}s),
{name}e AS (SELECT *, c1 - 2*az*m AS bz, c0 - c1*m + az*m*m AS cz, xc - ax*m AS bx FROM {name}d),
{name} AS (SELECT *, LEAST(GREATEST(CASE WHEN az < -1e-6 THEN SQRT(9.81/(-2*az)) ELSE 25 END, 1), 80) AS vy, LEAST(GREATEST(CASE WHEN az < -1e-6 THEN SQRT(9.81/(-2*az)) ELSE 25 END, 1), 80) * SQRT(1 + ax*ax + (2*az*y_first+bz)*(2*az*y_first+bz)) AS speed_ms FROM {name}e)"""


@query("a9_parabola_fits", f"""WITH {RALLIES}, {fit_sql('rr', KEY)},
q AS (SELECT rr.session_id, rr.rally, AVG(SQRT(POW(ax*rr.y+bx-rr.x,2) + POW(az*rr.y*rr.y+bz*rr.y+cz-rr.z,2))) AS mean_error FROM rr JOIN ft USING (session_id, rally) GROUP BY 1, 2)
SELECT ft.session_id, ft.rally, n, ROUND(ax, 5) AS ax, ROUND(az, 5) AS az, ROUND(bz, 5) AS bz, ROUND(cz, 5) AS cz, ROUND(speed_ms, 4) AS speed_ms, ROUND(mean_error, 5) AS mean_error FROM ft JOIN q USING (session_id, rally)""")
def _(spark, sf):
    rows = rallies(spark, sf)
    f = FT.fit_quality(rows, FT.parabola_fits(rows, KEY), KEY)
    return rounded(f.select(*KEY, "n", "ax", "az", "bz", "cz", r("speed_ms", 4).alias("speed_ms"), "mean_error"), "ax", "az", "bz", "cz", "mean_error")


@query("a9_gravity_fits", f"""WITH {RALLIES}, a AS (SELECT *, t - MIN(t) OVER (PARTITION BY session_id, rally) AS dt FROM rr)
SELECT session_id, rally, COUNT(*) AS n, ROUND(REGR_SLOPE(x, dt), 5) AS vx, ROUND(REGR_SLOPE(z + 4.905*dt*dt, dt), 5) AS vz, ROUND(REGR_INTERCEPT(y, dt), 5) AS py FROM a GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(FT.gravity_fits(rallies(spark, sf), KEY).select(*KEY, "n", "vx", "vz", "py"), "vx", "vz", "py")


LANDING = """, ln AS (SELECT *, CASE WHEN bz*bz-4*az*cz >= 0 AND ABS(az) > 1e-9 THEN (-bz + SQRT(GREATEST(bz*bz-4*az*cz, 0)))/(2*az) END AS y1, CASE WHEN bz*bz-4*az*cz >= 0 AND ABS(az) > 1e-9 THEN (-bz - SQRT(GREATEST(bz*bz-4*az*cz, 0)))/(2*az) END AS y2 FROM ft),
lo AS (SELECT *, CASE WHEN ABS(y1) <= 13.885 AND (y2 IS NULL OR ABS(y2) > 13.885 OR ABS(y1-y_first) >= ABS(y2-y_first)) THEN y1 WHEN ABS(y2) <= 13.885 THEN y2 END AS land_y FROM ln)"""


@query("m4_landing_and_net", f"""WITH {RALLIES}, {fit_sql('rr', KEY)}{LANDING}
SELECT session_id, rally, ROUND(land_y, 4) AS land_y, ROUND(ax*land_y+bx, 4) AS land_x, CASE WHEN y_min <= 3 AND y_max >= -3 AND cz BETWEEN -1 AND 10 THEN cz > 0.914 END AS clears_net,
  ROUND(CASE WHEN y_min <= 3 AND y_max >= -3 AND cz BETWEEN -1 AND 10 THEN LEAST(vy*SQRT(1+ax*ax+bz*bz)*3.6, 350) END, 3) AS net_kmh FROM lo""")
def _(spark, sf):
    f = FT.net_passage(FT.landing(FT.parabola_fits(rallies(spark, sf), KEY), F.col("y_first")))
    return f.select(*KEY, r("land_y", 4).alias("land_y"), r("land_x", 4).alias("land_x"), "clears_net", r("net_kmh", 3).alias("net_kmh"))


@query("m5_smooth_curve", f"""WITH {RALLIES}, {fit_sql('rr', KEY)}, c AS (SELECT *, UNNEST(RANGE(200)) AS i FROM ft), e AS (SELECT *, y_min + (y_max - y_min) * i / 199 AS y FROM c)
SELECT session_id, rally, i, ROUND(ax*y+bx, 4) AS x, ROUND(az*y*y+bz*y+cz, 4) AS z FROM e WHERE az*y*y+bz*y+cz BETWEEN -0.3 AND 6""")
def _(spark, sf):
    c = FT.smooth_curve(FT.parabola_fits(rallies(spark, sf), KEY), KEY)
    return c.select(*KEY, F.col("i").cast("long").alias("i"), r("x", 4).alias("x"), r("z", 4).alias("z"))


STROKES = """,
mn AS (SELECT *, LAG(z) OVER w AS pz, LEAD(z) OVER w AS nz FROM rr WINDOW w AS (PARTITION BY session_id, rally ORDER BY frame)),
bb AS (SELECT session_id, rally, frame FROM mn WHERE z < 0.3 AND z < pz AND z < nz),
k1 AS (SELECT rr.*, bb.frame IS NOT NULL AS isb, SUM(CASE WHEN bb.frame IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY rr.session_id, rr.rally ORDER BY rr.frame) AS stroke FROM rr LEFT JOIN bb ON bb.session_id = rr.session_id AND bb.rally = rr.rally AND bb.frame = rr.frame),
st AS (SELECT session_id, rally, stroke, frame, t, x, y, z, ray_dist FROM k1 UNION ALL SELECT session_id, rally, stroke - 1, frame, t, x, y, z, ray_dist FROM k1 WHERE isb)"""


@query("a12_strokes", f"""WITH {RALLIES}{STROKES}, {fit_sql('st', ['session_id', 'rally', 'stroke'], min_rows=6)}{LANDING}
SELECT session_id, rally, stroke, n, ROUND(speed_ms, 3) AS speed_ms, ROUND(land_y, 3) AS land_y FROM lo""")
def _(spark, sf):
    rows = rallies(spark, sf)
    b = minima(rows)
    st = FT.stroke_rows(rows, b)
    f = FT.landing(FT.parabola_fits(st, [*KEY, "stroke"], 6), F.col("y_first"))
    return f.select(*KEY, "stroke", "n", r("speed_ms", 3).alias("speed_ms"), r("land_y", 3).alias("land_y"))


def minima(rows):
    from ..operators.ordered import windowed

    t = windowed(rows, KEY, "frame", lambda t, w: t.withColumn("_h", (F.col("z") < 0.3) & (F.col("z") < F.lag("z").over(w)) & (F.col("z") < F.lead("z").over(w))), 26, 26)
    return t.where("_h").select(*KEY, "frame", "x", "y", "z")


@query("a10_ransac_fits")
def _(spark, sf):
    rows = cut_lineage(rallies(spark, sf))
    inl = FT.ransac_fits(rows, KEY, trials=300)
    return rounded(FT.parabola_fits(inl, KEY).select(*KEY, "n", "ax", "az", "speed_ms"), "ax", "az", "speed_ms")


@query("a11_trajectory_assembly")
def _(spark, sf):
    rows = cut_lineage(rallies(spark, sf))
    inl = cut_lineage(FT.ransac_fits(rows, KEY, trials=300))
    cut = cut_lineage(FT.best_split(inl, cut_lineage(B.robust_minima(inl))))
    s = FT.strokes(inl, cut)
    return rounded(FT.net_passage(s).select(*KEY, "stroke", "n", "speed_ms", "mean_error", "land_y", "net_kmh"), "speed_ms", "mean_error", "land_y", "net_kmh")


@query("w15_best_split")
def _(spark, sf):
    rows = cut_lineage(rallies(spark, sf))
    return FT.best_split(rows, B.robust_minima(rows))


@query("w3_flight_segments", """
WITH a AS (SELECT *, frame - LAG(frame) OVER w AS gap, SQRT(POW(x-LAG(x) OVER w,2)+POW(y-LAG(y) OVER w,2)+POW(z-LAG(z) OVER w,2)) AS d FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
b AS (SELECT *, CASE WHEN gap IS NULL OR gap > 5 OR d / (gap / 25.0) > 50 THEN 1 ELSE 0 END AS b FROM a), s AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM b)
SELECT session_id, MIN(frame) AS seg, COUNT(*) AS n FROM s GROUP BY session_id, g HAVING COUNT(*) >= 4""")
def _(spark, sf):
    from ..operators.ordered import segments

    fast = lambda w: M.step_dist(w) / ((F.col("frame") - F.lag("frame").over(w)) / 25.0) > 50
    s = segments(table(spark, sf, "points"), ["session_id"], "frame", 5, "seg", fast)
    return s.groupBy("session_id", "seg").agg(F.count("*").alias("n")).where("n >= 4")


def linked(spark, sf, cam):
    t = TR.link_blobs(table(spark, sf, "cands").where(F.col("camera") == cam), max_px=120.0, min_rows=5)
    return cut_lineage(G.pixel_to_world(t, table(spark, sf, "cams")))


@query("w46_linked_tracks")
def _(spark, sf):
    return rounded(linked(spark, sf, "cam66").select("session_id", "camera", "track", "frame", "length", "pixel_x"), "pixel_x")


@query("j11_matched_tracks")
def _(spark, sf):
    m = TR.match_tracks(linked(spark, sf, "cam66"), linked(spark, sf, "cam68"), CAM_A, CAM_B, min_common=4)
    return rounded(m.select("session_id", "track_a", "track_b", "overlap", "z_ok", "median_ray").distinct(), "z_ok", "median_ray")


@query("j12_merged_tracks")
def _(spark, sf):
    m = TR.match_tracks(linked(spark, sf, "cam66"), linked(spark, sf, "cam68"), CAM_A, CAM_B, min_common=4)
    return rounded(TR.merge_tracks(m), "x", "y", "z", "ray_dist")


@query("j10_best_paths")
def _(spark, sf):
    return rounded(TR.best_paths(pairs(spark, sf)), "x", "y", "z", "emit", "ray_dist")
