"""Event detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounce as B
from ..operators import motion as M
from ..operators import peaks as PK
from ..operators import strokes as K
from .fixtures import table
from .motion import RALLIES, rallies
from .registry import query, r

KEYS = ["session_id"]


def peaks_sql(src: str, keys: str, value: str, distance: int, prom: float, p: str) -> str:
    """Peaks of ``value``: local maxima incl. plateau middles, score-first thinning, prominence."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    pre = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    w = f"(PARTITION BY {keys} ORDER BY frame)"
    return f"""
{p}i AS (SELECT *, {value} AS v, ROW_NUMBER() OVER {w} - 1 AS idx FROM {src}),
{p}r AS (SELECT *, CASE WHEN v IS DISTINCT FROM LAG(v) OVER {w} THEN 1 ELSE 0 END AS nw FROM {p}i),
{p}g AS (SELECT *, SUM(nw) OVER {w} AS run FROM {p}r),
{p}u AS (SELECT {keys}, run, MIN(idx) AS a, MAX(idx) AS b, MIN(v) AS v FROM {p}g GROUP BY {keys}, run),
{p}n AS (SELECT *, LAG(v) OVER (PARTITION BY {keys} ORDER BY run) AS pv, LEAD(v) OVER (PARTITION BY {keys} ORDER BY run) AS nv FROM {p}u),
{p}c AS (SELECT {keys}, (a + b) // 2 AS idx, v, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY v DESC, (a + b) // 2 DESC) AS q FROM {p}n WHERE v > pv AND v > nv),
{p}k AS (SELECT {keys}, q, [idx] AS kept FROM {p}c WHERE q = 1
  UNION ALL SELECT {pre(p + 'c')}, {p}c.q, CASE WHEN LEN(LIST_FILTER({p}k.kept, lambda z: ABS(z - {p}c.idx) < {distance})) = 0 THEN LIST_APPEND({p}k.kept, {p}c.idx) ELSE {p}k.kept END
  FROM {p}k JOIN {p}c ON {on(p + 'k', p + 'c')} AND {p}c.q = {p}k.q + 1),
{p}l AS (SELECT {keys}, UNNEST(kept) AS idx FROM (SELECT * FROM {p}k QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY q DESC) = 1)),
{p}h AS (SELECT i.*, (SELECT MAX(j.idx) FROM {p}i j WHERE {on('j', 'i')} AND j.idx < i.idx AND j.v > i.v) AS lg, (SELECT MIN(j.idx) FROM {p}i j WHERE {on('j', 'i')} AND j.idx > i.idx AND j.v > i.v) AS rg
  FROM {p}i i JOIN {p}l ON {on('i', p + 'l')} AND i.idx = {p}l.idx),
{p}m AS (SELECT h.*, (SELECT MIN(j.v) FROM {p}i j WHERE {on('j', 'h')} AND j.idx < h.idx AND j.idx > COALESCE(h.lg, -1)) AS lm,
  (SELECT MIN(j.v) FROM {p}i j WHERE {on('j', 'h')} AND j.idx > h.idx AND j.idx < COALESCE(h.rg, 1000000000)) AS rm FROM {p}h h),
{p}p AS (SELECT * FROM {p}m WHERE v - lm >= {prom} AND v - rm >= {prom})"""


ZS = "zs AS (SELECT *, (COALESCE(LAG(z) OVER w, z) + z + COALESCE(LEAD(z) OVER w, z)) / 3 AS zs FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame))"
PEAKS = f"{ZS}, {peaks_sql('zs', 'session_id', '-zs', 5, 0.1, 'pk')}"


@query("w13_peak_bounces", f"WITH RECURSIVE {PEAKS} SELECT session_id, frame, ROUND(zs, 6) AS z, ABS(x) <= 4.265 AND ABS(y) <= 12.035 AS in_court FROM pkp WHERE zs > 0.02 AND zs <= 0.5")
def _(spark, sf):
    return B.peak_bounces(table(spark, sf, "points")).select("session_id", "frame", r("z").alias("z"), "in_court")


@query("w14_events", f"""WITH RECURSIVE {PEAKS}, bb AS (SELECT session_id, frame, y, zs FROM pkp WHERE zs <= 0.5),
sv AS (SELECT *, SQRT(POW((x-LAG(x) OVER w)/((frame-LAG(frame) OVER w)/25.0), 2) + POW((y-LAG(y) OVER w)/((frame-LAG(frame) OVER w)/25.0), 2) + POW((zs-LAG(zs) OVER w)/((frame-LAG(frame) OVER w)/25.0), 2)) AS v FROM zs WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
sd AS (SELECT *, ABS(LEAD(v) OVER (PARTITION BY session_id ORDER BY frame) - v) AS dv FROM sv),
st AS (SELECT * FROM sd WHERE dv > 15 AND zs > 0.5 AND NOT EXISTS (SELECT 1 FROM bb WHERE bb.session_id = sd.session_id AND ABS(bb.frame - sd.frame) < 5)),
sf AS (SELECT session_id, MIN(frame) AS f FROM st WHERE ABS(y) > 8 GROUP BY session_id)
SELECT session_id, frame, 'bounce' AS kind, ROUND(zs, 6) AS z FROM bb UNION ALL SELECT st.session_id, frame, CASE WHEN frame = f THEN 'serve' ELSE 'shot' END, ROUND(zs, 6) FROM st LEFT JOIN sf USING (session_id)""")
def _(spark, sf):
    return B.events(table(spark, sf, "points")).select("session_id", "frame", "kind", r("z").alias("z"))


@query("w15_simple_minima", "SELECT session_id, frame, ROUND(z, 6) AS z FROM (SELECT *, LAG(z) OVER w AS p, LEAD(z) OVER w AS n FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)) WHERE z < 0.3 AND z < p AND z < n")
def _(spark, sf):
    return B.simple_minima(table(spark, sf, "points")).select("session_id", "frame", r("z").alias("z"))


@query("w15_robust_minima", f"""WITH RECURSIVE {RALLIES},
m1 AS (SELECT *, ROW_NUMBER() OVER w - 1 AS idx, LAG(z) OVER w AS p, LEAD(z) OVER w AS n, MAX(z) OVER (PARTITION BY session_id, rally ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ma,
  MAX(z) OVER (PARTITION BY session_id, rally ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mb FROM rr WINDOW w AS (PARTITION BY session_id, rally ORDER BY frame)),
m2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, rally ORDER BY frame) AS i FROM m1 WHERE z < 0.5 AND z <= p AND z <= n AND ma > z + 0.05 AND mb > z + 0.05),
m3 AS (SELECT session_id, rally, i, idx AS ki, frame AS kf, z AS kz, 1 AS g FROM m2 WHERE i = 1
  UNION ALL SELECT m2.session_id, m2.rally, m2.i, CASE WHEN m2.idx - ki >= 3 OR m2.z < kz THEN m2.idx ELSE ki END, CASE WHEN m2.idx - ki >= 3 OR m2.z < kz THEN m2.frame ELSE kf END, CASE WHEN m2.idx - ki >= 3 OR m2.z < kz THEN m2.z ELSE kz END,
  CASE WHEN m2.idx - ki >= 3 THEN g + 1 ELSE g END FROM m3 JOIN m2 ON m2.session_id = m3.session_id AND m2.rally = m3.rally AND m2.i = m3.i + 1)
SELECT session_id, rally, kf AS frame, ROUND(kz, 6) AS z FROM m3 QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, rally, g ORDER BY i DESC) = 1""")
def _(spark, sf):
    return B.robust_minima(rallies(spark, sf)).select("session_id", "rally", "frame", r("z").alias("z"))


def hybrid_sql(vr, halves, zmax, gap, dense, nb, na):
    m = max(max(halves), vr)
    fits = []
    for h in halves:
        for n, lo, hi in (("l", -h, 0), ("r", 0, h), ("j", -h, h)):
            fits.append((f"{n}{h}", lo, hi))
    sums = ", ".join(f"SUM(POW(d, {k})) FILTER (o BETWEEN {lo} AND {hi}) AS {n}s{k}" for n, lo, hi in fits for k in range(5))
    tz = ", ".join(f"SUM(z2 * POW(d, {k})) FILTER (o BETWEEN {lo} AND {hi}) AS {n}b{k}" for n, lo, hi in fits for k in range(3))
    zz = ", ".join(f"SUM(z2 * z2) FILTER (o BETWEEN {lo} AND {hi}) AS {n}q" for n, lo, hi in fits)

    def mse(n):
        s, b = [f"{n}s{k}" for k in range(5)], [f"{n}b{k}" for k in range(3)]
        det = f"({s[0]}*({s[2]}*{s[4]}-{s[3]}*{s[3]}) - {s[1]}*({s[1]}*{s[4]}-{s[2]}*{s[3]}) + {s[2]}*({s[1]}*{s[3]}-{s[2]}*{s[2]}))"
        c0 = f"({b[0]}*({s[2]}*{s[4]}-{s[3]}*{s[3]}) - {s[1]}*({b[1]}*{s[4]}-{s[3]}*{b[2]}) + {s[2]}*({b[1]}*{s[3]}-{s[2]}*{b[2]}))/{det}"
        c1 = f"({s[0]}*({b[1]}*{s[4]}-{b[2]}*{s[3]}) - {b[0]}*({s[1]}*{s[4]}-{s[2]}*{s[3]}) + {s[2]}*({s[1]}*{b[2]}-{b[1]}*{s[2]}))/{det}"
        c2 = f"({s[0]}*({s[2]}*{b[2]}-{s[3]}*{b[1]}) - {s[1]}*({s[1]}*{b[2]}-{s[2]}*{b[1]}) + {b[0]}*({s[1]}*{s[3]}-{s[2]}*{s[2]}))/{det}"
        return f"(({n}q - {c0}*{b[0]} - {c1}*{b[1]} - {c2}*{b[2]})/{s[0]})"

    ratio = ", ".join(f"CASE WHEN ({mse(f'l{h}')}+{mse(f'r{h}')})/2 > 1e-8 THEN {mse(f'j{h}')}/(({mse(f'l{h}')}+{mse(f'r{h}')})/2) ELSE 0 END" for h in halves)
    return f"""
hs AS (SELECT *, CASE WHEN frame - LAG(frame) OVER w <= {gap} THEN 0 ELSE 1 END AS br, LAG({{'f': frame, 'x': x, 'y': y, 'z': z}}, 3) OVER w AS pa, LEAD({{'f': frame, 'x': x, 'y': y, 'z': z}}, 3) OVER w AS pb,
  COUNT(*) OVER (PARTITION BY session_id ORDER BY frame RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS dn FROM points WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
hg AS (SELECT *, SUM(br) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM hs),
hi AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, g ORDER BY frame) AS i, COUNT(*) OVER (PARTITION BY session_id, g) AS n,
  AVG(z) OVER (PARTITION BY session_id, g ORDER BY frame ROWS BETWEEN {vr} PRECEDING AND 1 PRECEDING) - z AS mb, AVG(z) OVER (PARTITION BY session_id, g ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND {vr} FOLLOWING) - z AS ma FROM hg),
hc AS (SELECT * FROM hi WHERE i > {nb} AND n - i >= {na} AND z <= {zmax} AND ABS(x) <= 5.115 AND ABS(y) <= 12.885 AND dn >= {dense}
  AND SQRT((pb.x-pa.x)*(pb.x-pa.x) + (pb.y-pa.y)*(pb.y-pa.y) + (pb.z-pa.z)*(pb.z-pa.z)) / ((pb.f-pa.f)/25.0) >= 3 AND LEAST(mb, ma) >= 0.05 AND GREATEST(mb, ma) >= 0.1),
hf AS (SELECT c.session_id, c.frame, {sums}, {tz}, {zz} FROM (SELECT c.session_id, c.frame, (k.frame - c.frame)::DOUBLE / 25 AS d, k.i - c.i AS o, k.z AS z2 FROM hc c JOIN hi k ON k.session_id = c.session_id AND k.g = c.g AND k.i BETWEEN c.i - {m} AND c.i + {m}) c GROUP BY c.session_id, c.frame),
hr AS (SELECT session_id, frame, GREATEST({ratio}) AS ratio FROM hf),
ha AS (SELECT hc.session_id, hc.frame, hc.g, x, y, z, mb + ma AS vs, ratio FROM hc JOIN hr USING (session_id, frame) WHERE (LEAST(mb, ma) >= 0.1 AND GREATEST(mb, ma) >= 0.2) OR ratio >= 5 OR (ratio >= 2 AND z < 0.4))"""


@query("w19_hybrid_bounces", f"""WITH RECURSIVE {hybrid_sql(4, (3, 4, 6), 1.5, 3, 20, 6, 6)},
c AS (SELECT *, vs + 0.1 * ratio AS sc, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM ha),
k AS (SELECT session_id, i, frame AS kf, sc AS ks, z AS kz, 1 AS grp FROM c WHERE i = 1
  UNION ALL SELECT c.session_id, c.i, CASE WHEN c.frame - kf >= 5 OR c.sc > ks THEN c.frame ELSE kf END, CASE WHEN c.frame - kf >= 5 OR c.sc > ks THEN c.sc ELSE ks END, CASE WHEN c.frame - kf >= 5 OR c.sc > ks THEN c.z ELSE kz END,
  CASE WHEN c.frame - kf >= 5 THEN grp + 1 ELSE grp END FROM k JOIN c ON c.session_id = k.session_id AND c.i = k.i + 1)
SELECT session_id, kf AS frame, ROUND(kz, 6) AS z FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, grp ORDER BY i DESC) = 1""")
def _(spark, sf):
    return B.hybrid_bounces(table(spark, sf, "points")).select("session_id", "frame", r("z").alias("z"))


@query("w18_hybrid_bounces_live", f"""WITH RECURSIVE {hybrid_sql(8, (4, 6, 8), 0.8, 5, 17, 8, 8)},
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM ha),
k AS (SELECT session_id, i, frame AS kf, TRUE AS keep FROM c WHERE i = 1
  UNION ALL SELECT c.session_id, c.i, CASE WHEN c.frame - kf >= 12 THEN c.frame ELSE kf END, c.frame - kf >= 12 FROM k JOIN c ON c.session_id = k.session_id AND c.i = k.i + 1),
b AS (SELECT c.* FROM c JOIN k ON k.session_id = c.session_id AND k.i = c.i WHERE keep),
ci AS (SELECT b.session_id, b.frame, b.vs, b.ratio, h.i AS ri, h.g FROM b JOIN hi h ON h.session_id = b.session_id AND h.frame = b.frame)
SELECT ci.session_id, ci.frame, ARG_MIN(h.frame, (h.z, h.frame)) AS land_frame, ROUND(MIN(h.z), 6) AS z FROM ci JOIN hi h ON h.session_id = ci.session_id AND h.g = ci.g AND h.i BETWEEN ci.ri - 4 AND ci.ri + 4 GROUP BY ci.session_id, ci.frame""")
def _(spark, sf):
    return B.hybrid_bounces_live(table(spark, sf, "points")).select("session_id", "frame", "land_frame", r("z").alias("z"))


PB = """
pd1 AS (SELECT *, MEDIAN(pixel_y) OVER (PARTITION BY session_id, camera ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ps, CASE WHEN frame - LAG(frame) OVER w <= 7 THEN 0 ELSE 1 END AS br,
  FIRST_VALUE({'f': frame, 'x': pixel_x, 'y': pixel_y}) OVER (PARTITION BY session_id, camera ORDER BY frame ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a, LAST_VALUE({'f': frame, 'x': pixel_x, 'y': pixel_y}) OVER (PARTITION BY session_id, camera ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS b,
  MAX(pixel_y) OVER v - MIN(pixel_y) OVER v AS rg FROM det WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame), v AS (PARTITION BY session_id, camera ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
pd2 AS (SELECT *, SUM(br) OVER (PARTITION BY session_id, camera ORDER BY frame) AS g FROM pd1),
pd3 AS (SELECT *, CASE WHEN COUNT(*) OVER l = 4 THEN ps - MIN(ps) OVER l END AS ml, CASE WHEN COUNT(*) OVER q = 4 THEN ps - MIN(ps) OVER q END AS mr, ps >= MAX(ps) OVER c - 1 AS pk, ps - LAG(ps, 4) OVER s > 8 AS dn, ps - LEAD(ps, 4) OVER s > 8 AS up FROM pd2
  WINDOW s AS (PARTITION BY session_id, camera, g ORDER BY frame), l AS (PARTITION BY session_id, camera, g ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY session_id, camera, g ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
  c AS (PARTITION BY session_id, camera, g ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pd4 AS (SELECT *, ml + mr AS score FROM pd3 WHERE ps >= 200 AND LEAST(ml, mr) > 0 AND GREATEST(ml, mr) >= 20 AND LEAST(ml, mr) >= 10 AND pk AND dn AND up AND CASE WHEN camera = 'cam66' THEN world_y <= 2 ELSE world_y >= -2 END
  AND SQRT((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) / (b.f - a.f) >= 1 AND rg >= 80),
pd5 AS (SELECT * FROM pd4 c WHERE (SELECT COUNT(DISTINCT d.frame) FROM det d WHERE d.session_id = c.session_id AND ABS(d.frame - c.frame) <= 20) >= 15
  AND (SELECT COUNT(*) >= 3 AND MAX(z) >= 0.5 AND LIST(z ORDER BY frame)[-1] < LIST(z ORDER BY frame)[-3] FROM points p WHERE p.session_id = c.session_id AND p.frame BETWEEN c.frame - 12 AND c.frame - 1)),
pd6 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM (SELECT * FROM pd5 QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, frame ORDER BY score DESC, camera) = 1)),
pd7 AS (SELECT session_id, i, frame AS kf, score AS ks, camera AS kc, 1 AS grp FROM pd6 WHERE i = 1
  UNION ALL SELECT c.session_id, c.i, CASE WHEN c.frame - kf >= 20 OR c.score > ks THEN c.frame ELSE kf END, CASE WHEN c.frame - kf >= 20 OR c.score > ks THEN c.score ELSE ks END, CASE WHEN c.frame - kf >= 20 OR c.score > ks THEN c.camera ELSE kc END,
  CASE WHEN c.frame - kf >= 20 THEN grp + 1 ELSE grp END FROM pd7 k JOIN pd6 c ON c.session_id = k.session_id AND c.i = k.i + 1),
p2 AS (SELECT session_id, kf AS frame, kc AS camera, ks AS score FROM pd7 QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, grp ORDER BY i DESC) = 1)"""


def image_bounces(spark, sf):
    return B.pixel_bounces(table(spark, sf, "det"), table(spark, sf, "points"), window=4, gap=7, min_speed=1.0)


@query("w20_pixel_bounces", f"WITH RECURSIVE {PB} SELECT session_id, frame, camera, ROUND(score, 5) AS score FROM p2")
def _(spark, sf):
    return image_bounces(spark, sf).select("session_id", "frame", "camera", r("score", 5).alias("score"))


@query("w21_refine_by_pixels")
def _(spark, sf):
    b = B.refine_by_pixels(table(spark, sf, "gt_events"), table(spark, sf, "det"))
    return b.select("session_id", "frame_3d", "frame", "camera", r("x", 5).alias("x"))


@query("w21_u4_merge_with_pixels", f"WITH RECURSIVE {PB} SELECT session_id, frame, '3d' AS origin FROM gt_events UNION ALL SELECT session_id, frame, '2d' FROM p2 WHERE score >= 100 AND NOT EXISTS (SELECT 1 FROM gt_events g WHERE g.session_id = p2.session_id AND ABS(g.frame - p2.frame) <= 2)")
def _(spark, sf):
    return B.merge_with_pixels(table(spark, sf, "gt_events"), image_bounces(spark, sf), 2, 100.0)


LONG = """
t1 AS (SELECT *, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS br FROM {src}),
t2 AS (SELECT *, SUM(br) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM t1),
ls AS (SELECT * FROM t2 QUALIFY COUNT(*) OVER (PARTITION BY session_id, g) >= 5)"""


def cooldown_sql(src, gap, p="cd"):
    return f"""{p}i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM {src}),
{p}k AS (SELECT session_id, i, frame AS kf, TRUE AS keep FROM {p}i WHERE i = 1 UNION ALL SELECT c.session_id, c.i, CASE WHEN c.frame - kf >= {gap} THEN c.frame ELSE kf END, c.frame - kf >= {gap} FROM {p}k JOIN {p}i c ON c.session_id = {p}k.session_id AND c.i = {p}k.i + 1),
{p} AS (SELECT c.* FROM {p}i c JOIN {p}k ON {p}k.session_id = c.session_id AND {p}k.i = c.i WHERE keep)"""


@query("w24_extrema_bounces", f"""WITH RECURSIVE {LONG.format(src='det66')}, {peaks_sql('ls', 'session_id, g', 'world_y', 5, 0.5, 'xa')}, {peaks_sql('ls', 'session_id, g', '-world_y', 5, 0.5, 'xb')}, {peaks_sql('ls', 'session_id, g', 'pixel_y', 5, 8.0, 'xc')},
un AS (SELECT session_id, frame, 'far' AS side, 0 AS o FROM xap WHERE world_y > -10 AND world_y < 20 UNION ALL SELECT session_id, frame, 'near', 1 FROM xbp WHERE world_y > -10 AND world_y < 20 UNION ALL SELECT session_id, frame, 'near', 2 FROM xcp WHERE pixel_y > 100),
un1 AS (SELECT * FROM un QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, frame ORDER BY o) = 1), {cooldown_sql('un1', 8)} SELECT session_id, frame, side FROM cd""")
def _(spark, sf):
    return K.extrema_bounces(table(spark, sf, "det66")).select("session_id", "frame", "side")


@query("w25_agreement_bounces", f"""WITH RECURSIVE jj AS (SELECT a.session_id, a.frame, a.world_y, SQRT(POW(a.world_x-b.world_x, 2) + POW(a.world_y-b.world_y, 2)) AS dist FROM det66 a JOIN det68 b ON a.session_id = b.session_id AND a.frame = b.frame),
{LONG.format(src='jj')}, {peaks_sql('ls', 'session_id, g', '-dist', 5, 1.0, 'xa')}, ok AS (SELECT * FROM xap WHERE dist <= 4), {cooldown_sql('ok', 8)} SELECT session_id, frame, ROUND(dist, 5) AS dist, CASE WHEN world_y < 0 THEN 'near' ELSE 'far' END AS side FROM cd""")
def _(spark, sf):
    return K.agreement_bounces(table(spark, sf, "det66"), table(spark, sf, "det68")).select("session_id", "frame", r("dist", 5).alias("dist"), "side")


SERVES = """
v1 AS (SELECT session_id, frame, world_y AS wy, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) <= 7 THEN 0 ELSE 1 END AS st FROM det66),
v2 AS (SELECT *, CASE WHEN wy < -6.885 THEN -1 ELSE 1 END AS sg FROM v1 WHERE st = 1 AND (wy < -6.885 OR wy > 6.885)),
v3 AS (SELECT s.session_id, s.frame AS start_frame, s.sg, d.frame, d.world_y * s.sg AS deep, d.world_y AS wy FROM v2 s JOIN det66 d ON d.session_id = s.session_id AND d.frame BETWEEN s.frame AND s.frame + 40 QUALIFY ROW_NUMBER() OVER (PARTITION BY s.session_id, s.frame ORDER BY d.frame) <= 40),
v4 AS (SELECT *, MIN(CASE WHEN deep < 4.885 THEN frame END) OVER (PARTITION BY session_id, start_frame) AS leave FROM v3),
vs AS (SELECT session_id, start_frame, MAX(frame) AS frame, CASE WHEN MIN(sg) < 0 THEN 'near' ELSE 'far' END AS side FROM v4 WHERE deep > 6.885 AND (leave IS NULL OR frame < leave) GROUP BY session_id, start_frame)"""


@query("w29_serves", f"WITH {SERVES} SELECT * FROM vs")
def _(spark, sf):
    return K.serves(table(spark, sf, "det66"), gap=7).select("session_id", "start_frame", "frame", "side")


@query("w30_shots", f"""WITH RECURSIVE {SERVES},
n AS (SELECT session_id, frame, frame - LAG(frame) OVER w AS b, LEAD(frame) OVER w - frame AS a, (world_y - LAG(world_y) OVER w) / (frame - LAG(frame) OVER w) AS yb, (LEAD(world_y) OVER w - world_y) / (LEAD(frame) OVER w - frame) AS ya,
  (world_x - LAG(world_x) OVER w) / (frame - LAG(frame) OVER w) AS xb, (LEAD(world_x) OVER w - world_x) / (LEAD(frame) OVER w - frame) AS xa FROM det66 WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
m AS (SELECT *, SQRT(xb*xb + yb*yb) AS sb, SQRT(xa*xa + ya*ya) AS sa FROM n WHERE b <= 5 AND a <= 5),
c AS (SELECT session_id, frame, CASE WHEN yb * ya < 0 THEN 'reversal' ELSE 'velocity' END AS method, CASE WHEN yb * ya < 0 THEN ABS(ya - yb) ELSE ABS(sa - sb) END AS score FROM m
  WHERE CASE WHEN yb * ya < 0 THEN ABS(ya - yb) > 0.4 ELSE LEAST(sb, sa) >= 0.3 AND GREATEST(sb, sa) >= 2.0 * LEAST(sb, sa) END),
e AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM gt_events g WHERE g.session_id = c.session_id AND ABS(g.frame - c.frame) <= CASE WHEN method = 'reversal' THEN 5 ELSE 2 END) AND NOT EXISTS (SELECT 1 FROM vs WHERE vs.session_id = c.session_id AND ABS(vs.frame - c.frame) <= 8)),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY score DESC, frame DESC) AS q FROM e),
k AS (SELECT session_id, q, [frame] AS kept FROM q WHERE q = 1 UNION ALL SELECT q.session_id, q.q, CASE WHEN LEN(LIST_FILTER(k.kept, lambda z: ABS(z - q.frame) < 10)) = 0 THEN LIST_APPEND(k.kept, q.frame) ELSE k.kept END FROM k JOIN q ON q.session_id = k.session_id AND q.q = k.q + 1),
l AS (SELECT session_id, UNNEST(kept) AS frame FROM (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY q DESC) = 1))
SELECT l.session_id, l.frame, e.method, ROUND(e.score, 5) AS score FROM l JOIN e ON e.session_id = l.session_id AND e.frame = l.frame""")
def _(spark, sf):
    d = table(spark, sf, "det66")
    s = K.shots(d, table(spark, sf, "gt_events"), K.serves(d, gap=7))
    return s.select("session_id", "frame", "method", r("score", 5).alias("score"))
