"""Smoothing, outlier and gap-filling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import hypot
from ..operators import compare as C
from ..operators import smooth as S
from ..operators.stats import quantiles
from .fixtures import CAM_A, CAM_B, table
from .geometry import _tri_sql
from .registry import query, r

SEG = """
s1 AS (SELECT *, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id, camera ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS b FROM {src}),
sg AS (SELECT *, SUM(b) OVER (PARTITION BY session_id, camera ORDER BY frame) AS g FROM s1)"""
P = "PARTITION BY session_id, camera, g ORDER BY frame"


def out(df, *extra, n=5):
    return df.select("session_id", "camera", "frame", r("pixel_x", n).alias("px"), r("pixel_y", n).alias("py"), *extra)


CONF = "q AS (SELECT session_id, camera, QUANTILE_CONT(blob_sum, 0.2) AS q FROM det GROUP BY session_id, camera), cf AS (SELECT d.* FROM det d JOIN q ON q.session_id = d.session_id AND q.camera = d.camera WHERE d.blob_sum >= q.q)"


@query("p10_confidence_percentile", f"WITH {CONF} SELECT session_id, camera, frame, ROUND(pixel_x, 5) AS px, ROUND(pixel_y, 5) AS py FROM cf")
def _(spark, sf):
    return out(S.confident(table(spark, sf, "det"), 0.2))


@query("w33_median_filter", f"WITH {SEG.format(src='det')} SELECT session_id, camera, frame, ROUND(MEDIAN(pixel_x) OVER w, 5) AS px, ROUND(MEDIAN(pixel_y) OVER w, 5) AS py FROM sg WINDOW w AS ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, sf):
    return out(S.median_filter(table(spark, sf, "det"), 5))


@query("w38_conf20_median5", f"WITH {CONF}, {SEG.format(src='cf')} SELECT session_id, camera, frame, ROUND(MEDIAN(pixel_x) OVER w, 5) AS px, ROUND(MEDIAN(pixel_y) OVER w, 5) AS py FROM sg WINDOW w AS ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, sf):
    return out(S.METHODS["best"](table(spark, sf, "det")))


def sg_sql(window, order, cols, src, tail=""):
    proj = "[" + ",".join("[" + ",".join(repr(float(v)) for v in row) + "]" for row in S.sg_matrix(window, order)) + "]"
    h = window // 2
    lists = ", ".join(f"LIST({c}) OVER (PARTITION BY session_id, {{cam}}g ORDER BY frame ROWS BETWEEN {window - 1} PRECEDING AND {window - 1} FOLLOWING) AS l_{c}" for c in cols)
    return f"""
n AS (SELECT *, LEAST(ROW_NUMBER() OVER (PARTITION BY session_id, {{cam}}g ORDER BY frame) - 1, {window - 1}) AS nb, LEAST(ROW_NUMBER() OVER (PARTITION BY session_id, {{cam}}g ORDER BY frame DESC) - 1, {window - 1}) AS na,
  {lists} FROM sg),
k AS (SELECT *, CASE WHEN nb < {h} THEN 0 WHEN na < {h} THEN nb + na + 1 - {window} ELSE nb - {h} END AS st, CASE WHEN nb < {h} THEN nb WHEN na < {h} THEN {window - 1} - na ELSE {h} END AS e FROM n),
sm AS (SELECT *, {', '.join(f"CASE WHEN nb + na + 1 >= {window} THEN LIST_DOT_PRODUCT(l_{c}[st + 1:st + {window}], ({proj})[e + 1]) ELSE {c} END AS s_{c}" for c in cols)} FROM k)"""


@query("w32_savitzky_golay", f"WITH {SEG.format(src='det')}, {sg_sql(7, 2, ('pixel_x', 'pixel_y'), 'det').format(cam='camera, ')} SELECT session_id, camera, frame, ROUND(s_pixel_x, 5) AS px, ROUND(s_pixel_y, 5) AS py FROM sm")
def _(spark, sf):
    return out(S.sg_smooth(table(spark, sf, "det"), 7, 2))


PSEG = """
s1 AS (SELECT *, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS b FROM points),
sg AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS g FROM s1)"""


@query("w32_savitzky_golay_3d", f"WITH {PSEG}, {sg_sql(11, 3, ('x', 'y', 'z'), 'points').format(cam='')} SELECT session_id, frame, ROUND(s_x, 5) AS x, ROUND(s_y, 5) AS y, ROUND(GREATEST(s_z, 0), 5) AS z FROM sm")
def _(spark, sf):
    t = S.sg_smooth(table(spark, sf, "points"), 11, 3, ("x", "y", "z"), ["session_id"], floor_cols=("z",))
    return t.select("session_id", "frame", *[r(c, 5).alias(c) for c in "xyz"])


def rec_sql(alpha):
    return f"""WITH RECURSIVE {SEG.format(src='det')},
n AS (SELECT session_id, camera, frame, g, pixel_x AS x, pixel_y AS y, ROW_NUMBER() OVER ({P}) AS i,
  SQRT((pixel_x-LAG(pixel_x) OVER ({P}))*(pixel_x-LAG(pixel_x) OVER ({P})) + (pixel_y-LAG(pixel_y) OVER ({P}))*(pixel_y-LAG(pixel_y) OVER ({P}))) AS sp FROM sg),
e AS (SELECT session_id, camera, g, i, frame, x, y FROM n WHERE i = 1
  UNION ALL SELECT n.session_id, n.camera, n.g, n.i, n.frame, ({alpha}) * n.x + (1 - ({alpha})) * e.x, ({alpha}) * n.y + (1 - ({alpha})) * e.y
  FROM e JOIN n ON n.session_id = e.session_id AND n.camera = e.camera AND n.g = e.g AND n.i = e.i + 1)
SELECT session_id, camera, frame, ROUND(x, 5) AS px, ROUND(y, 5) AS py FROM e"""


@query("w34_exponential_mean", rec_sql("0.5"))
def _(spark, sf):
    return out(S.ema(table(spark, sf, "det"), 0.5))


@query("w34_adaptive_mean", rec_sql("CASE WHEN n.sp > 25 THEN 0.9 ELSE 0.5 END"))
def _(spark, sf):
    return out(S.ema(table(spark, sf, "det"), 0.5, fast=0.9))


def kalman_sql(q, rr, reject, smoothed=True, skip=False, p0=100.0):
    h = "(CAST(n.frame - k.frame AS DOUBLE) / 25)"
    g = "(n.frame - k.frame)"
    a = f"(k.a + 2 * {h} * k.b + {h} * {h} * k.c + {0.1 * q} * {g})"
    b = f"(k.b + {h} * k.c)"
    c = f"(k.c + {q} * {g})"
    ix, iy = f"(n.x - k.px - {h} * k.vx)", f"(n.y - k.py - {h} * k.vy)"
    new = f"({g} > 10)"
    ok = f"(SQRT({ix}*{ix} + {iy}*{iy}) < {reject})"
    k0, k1 = f"({a} / ({a} + {rr}))", f"({b} / ({a} + {rr}))"
    restart = "FALSE" if skip else f"(NOT {ok})"
    pick = lambda fresh, upd, hold: f"CASE WHEN {new} OR {restart} THEN {fresh} WHEN {ok} THEN {upd} ELSE {hold} END"
    return f"""WITH RECURSIVE n AS (SELECT session_id, camera, frame, pixel_x AS x, pixel_y AS y, ROW_NUMBER() OVER (PARTITION BY session_id, camera ORDER BY frame) AS i FROM det),
k AS (SELECT session_id, camera, i, frame, x, y, x AS px, CAST(0 AS DOUBLE) AS vx, y AS py, CAST(0 AS DOUBLE) AS vy, CAST({p0} * {rr} / ({p0} + {rr}) AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST({p0} AS DOUBLE) AS c, TRUE AS kept FROM n WHERE i = 1
  UNION ALL SELECT n.session_id, n.camera, n.i, n.frame, n.x, n.y,
   {pick('n.x', f'k.px + {h} * k.vx + {k0} * {ix}', f'k.px + {h} * k.vx')}, {pick('0', f'k.vx + {k1} * {ix}', 'k.vx')},
   {pick('n.y', f'k.py + {h} * k.vy + {k0} * {iy}', f'k.py + {h} * k.vy')}, {pick('0', f'k.vy + {k1} * {iy}', 'k.vy')},
   {pick(p0, f'(1 - {k0}) * {a}', a)}, {pick('0', f'(1 - {k0}) * {b}', b)}, {pick(p0, f'{c} - {k1} * {b}', c)}, {new} OR {ok} OR {restart}
  FROM k JOIN n ON n.session_id = k.session_id AND n.camera = k.camera AND n.i = k.i + 1)
SELECT session_id, camera, frame, ROUND({'px' if smoothed else 'x'}, 5) AS px, ROUND({'py' if smoothed else 'y'}, 5) AS py FROM k WHERE kept"""


@query("w35_kalman", kalman_sql(50.0, 25.0, 200.0))
def _(spark, sf):
    return out(S.kalman(table(spark, sf, "det")))


@query("w35_kalman_gate", kalman_sql(80.0, 25.0, 150.0, smoothed=False, skip=True, p0=200.0))
def _(spark, sf):
    return out(S.kalman(table(spark, sf, "det"), 80.0, 5.0, 150.0, smoothed=False, skip_outliers=True, start_var=200.0))


@query("w36_bilateral", f"""WITH {SEG.format(src='det')},
n AS (SELECT *, SQRT((pixel_x-LAG(pixel_x) OVER w)*(pixel_x-LAG(pixel_x) OVER w) + (pixel_y-LAG(pixel_y) OVER w)*(pixel_y-LAG(pixel_y) OVER w)) AS dp,
  SQRT((LEAD(pixel_x) OVER w-pixel_x)*(LEAD(pixel_x) OVER w-pixel_x) + (LEAD(pixel_y) OVER w-pixel_y)*(LEAD(pixel_y) OVER w-pixel_y)) AS dn,
  {', '.join(f"(COALESCE(LAG({c},2) OVER w/3,0) + COALESCE(LAG({c}) OVER w/2,0) + {c} + COALESCE(LEAD({c}) OVER w/2,0) + COALESCE(LEAD({c},2) OVER w/3,0)) / (CASE WHEN LAG({c},2) OVER w IS NULL THEN 0 ELSE 1.0/3 END + CASE WHEN LAG({c}) OVER w IS NULL THEN 0 ELSE 0.5 END + 1 + CASE WHEN LEAD({c}) OVER w IS NULL THEN 0 ELSE 0.5 END + CASE WHEN LEAD({c},2) OVER w IS NULL THEN 0 ELSE 1.0/3 END) AS m_{c}" for c in ('pixel_x', 'pixel_y'))}
  FROM sg WINDOW w AS ({P}))
SELECT session_id, camera, frame, ROUND(CASE WHEN COALESCE(dp < 60 AND dn < 60, FALSE) THEN m_pixel_x ELSE pixel_x END, 4) AS px, ROUND(CASE WHEN COALESCE(dp < 60 AND dn < 60, FALSE) THEN m_pixel_y ELSE pixel_y END, 4) AS py FROM n""")
def _(spark, sf):
    return out(S.bilateral(table(spark, sf, "det"), jump=90.0, small=60.0), n=4)


@query("w37_confidence_weighted", f"""WITH {SEG.format(src='det')},
n AS (SELECT *, 0.3 + 0.7 * (blob_sum - MIN(blob_sum) OVER c) / (MAX(blob_sum) OVER c - MIN(blob_sum) OVER c) AS al, AVG(pixel_x) OVER w AS mx, AVG(pixel_y) OVER w AS my FROM sg
  WINDOW c AS (PARTITION BY session_id, camera), w AS ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT session_id, camera, frame, ROUND(al * pixel_x + (1 - al) * mx, 5) AS px, ROUND(al * pixel_y + (1 - al) * my, 5) AS py FROM n""")
def _(spark, sf):
    return out(S.confidence_weighted(table(spark, sf, "det")))


@query("w33_fill_linear", """
WITH n AS (SELECT *, LEAD(frame) OVER w AS nf, LEAD(pixel_x) OVER w AS nx, LEAD(pixel_y) OVER w AS ny FROM det WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame)),
e AS (SELECT *, UNNEST(RANGE(CASE WHEN nf - frame BETWEEN 2 AND 4 THEN nf - frame ELSE 1 END)) AS k FROM n)
SELECT session_id, camera, frame + k AS frame, ROUND(CASE WHEN k = 0 THEN pixel_x ELSE pixel_x + k / (nf - frame) * (nx - pixel_x) END, 5) AS px,
  ROUND(CASE WHEN k = 0 THEN pixel_y ELSE pixel_y + k / (nf - frame) * (ny - pixel_y) END, 5) AS py, k > 0 AS filled FROM e""")
def _(spark, sf):
    return out(S.fill_linear(table(spark, sf, "det")), "filled")


@query("w43_fill_quadratic", """
WITH n AS (SELECT session_id, camera, frame, pixel_x AS x, pixel_y AS y, LAG(frame) OVER w AS pf, LAG(pixel_x) OVER w AS px, LAG(pixel_y) OVER w AS py, LEAD(frame) OVER w AS nf, LEAD(pixel_x) OVER w AS nx, LEAD(pixel_y) OVER w AS ny,
  LEAD(frame, 2) OVER w AS mf, LEAD(pixel_x, 2) OVER w AS mx, LEAD(pixel_y, 2) OVER w AS my FROM det WINDOW w AS (PARTITION BY session_id, camera ORDER BY frame)),
g AS (SELECT * FROM n WHERE nf - frame BETWEEN 2 AND 4),
c AS (SELECT session_id, camera, frame, nf, pf - frame AS d, px AS x, py AS y FROM g WHERE frame - pf <= 10 UNION ALL SELECT session_id, camera, frame, nf, 0, x, y FROM g
  UNION ALL SELECT session_id, camera, frame, nf, nf - frame, nx, ny FROM g UNION ALL SELECT session_id, camera, frame, nf, mf - frame, mx, my FROM g WHERE mf - nf <= 10),
s AS (SELECT session_id, camera, frame, nf, CAST(COUNT(*) AS DOUBLE) AS s0, SUM(d::DOUBLE) AS s1, SUM((d*d)::DOUBLE) AS s2, SUM((d*d*d)::DOUBLE) AS s3, SUM((d*d*d*d)::DOUBLE) AS s4,
  SUM(x) AS x0, SUM(d*x) AS x1, SUM(d*d*x) AS x2, SUM(y) AS y0, SUM(d*y) AS y1, SUM(d*d*y) AS y2 FROM c GROUP BY 1, 2, 3, 4),
t AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det, UNNEST(RANGE(1, nf - frame)) AS k FROM s)
SELECT session_id, camera, frame + k AS frame, """ + ", ".join(f"""ROUND(LEAST(GREATEST(CASE WHEN s0 > 2 THEN ({v}0*(s2*s4-s3*s3) - s1*({v}1*s4-s3*{v}2) + s2*({v}1*s3-s2*{v}2))/det + (s0*({v}1*s4-{v}2*s3) - {v}0*(s1*s4-s2*s3) + s2*(s1*{v}2-{v}1*s2))/det*k
  + (s0*(s2*{v}2-s3*{v}1) - s1*(s1*{v}2-s2*{v}1) + {v}0*(s1*s3-s2*s2))/det*k*k ELSE ({v}0*s2-s1*{v}1)/(s0*s2-s1*s1) + (s0*{v}1-s1*{v}0)/(s0*s2-s1*s1)*k END, 0), {top}), 4) AS p{v}""" for v, top in (("x", 1920), ("y", 1080))) + " FROM t")
def _(spark, sf):
    return out(S.fill_quadratic(table(spark, sf, "det")), n=4)


@query("w40_median_outliers", """
WITH n AS (SELECT d.session_id, d.camera, d.frame, d.pixel_x AS x, d.pixel_y AS y, LIST({'f': frame, 'x': pixel_x, 'y': pixel_y}) OVER (PARTITION BY session_id, camera ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS l FROM det d),
c AS (SELECT session_id, camera, frame, x, y, LIST_FILTER(l, lambda s: ABS(s.f - frame) <= 8) AS l FROM n),
m AS (SELECT *, CASE WHEN LEN(l) >= 3 THEN LIST_MEDIAN(LIST_TRANSFORM(l, lambda s: s.x)) END AS mx, CASE WHEN LEN(l) >= 3 THEN LIST_MEDIAN(LIST_TRANSFORM(l, lambda s: s.y)) END AS my FROM c),
o AS (SELECT m.*, SQRT((x-mx)*(x-mx) + (y-my)*(y-my)) AS d FROM m),
b AS (SELECT o.session_id, o.camera, o.frame, k.pixel_x AS x, k.pixel_y AS y, SQRT((k.pixel_x-mx)*(k.pixel_x-mx) + (k.pixel_y-my)*(k.pixel_y-my)) AS dc, k.rank FROM o JOIN cands k ON k.session_id = o.session_id AND k.camera = o.camera AND k.frame = o.frame WHERE o.d > 100)
SELECT session_id, camera, frame, ROUND(x, 5) AS px, ROUND(y, 5) AS py, 'kept' AS origin FROM o WHERE d IS NULL OR d <= 100
UNION ALL SELECT session_id, camera, frame, ROUND(x, 5), ROUND(y, 5), 'reselected' FROM (SELECT * FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, camera, frame ORDER BY dc, rank) = 1) WHERE dc <= 100""")
def _(spark, sf):
    return out(S.median_outliers(table(spark, sf, "det"), table(spark, sf, "cands"), max_px=100.0), "origin")


# top picks of which every seventh is a decoy, each with the candidates of its frame and the rows after it
_MIXED = """tp AS (SELECT * FROM cands WHERE rank = CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END),
ks AS (SELECT session_id, camera, frame, LIST({{'x': pixel_x, 'y': pixel_y}} ORDER BY rank) AS cs FROM cands GROUP BY session_id, camera, frame),
t AS (SELECT tp.session_id, tp.camera, tp.frame, tp.pixel_x AS x, tp.pixel_y AS y, cs, ROW_NUMBER() OVER w AS i,
  LIST({{'f': tp.frame, 'x': tp.pixel_x, 'y': tp.pixel_y, 'i': 0}}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) AS nx
  FROM tp JOIN ks ON ks.session_id = tp.session_id AND ks.camera = tp.camera AND ks.frame = tp.frame WINDOW w AS (PARTITION BY tp.session_id, tp.camera ORDER BY tp.frame))"""


def mixed(spark, sf):
    """Top picks of which every seventh is a decoy."""
    return table(spark, sf, "cands").where(F.col("rank") == F.when(F.col("event_id") % 7 == 3, 1).otherwise(0)).select("session_id", "camera", "frame", "pixel_x", "pixel_y")


def _d(a, b):
    return f"SQRT(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


@query("w41_velocity_outliers", f"""WITH RECURSIVE {_MIXED.format(ahead=1)},
s AS (SELECT DISTINCT session_id, camera, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS STRUCT(x DOUBLE, y DOUBLE)) AS got, CAST(NULL AS STRUCT(f BIGINT, x DOUBLE, y DOUBLE)) AS p FROM t
  UNION ALL SELECT session_id, camera, i, frame, got, CASE WHEN got IS NULL THEN p ELSE {{'f': frame, 'x': got.x, 'y': got.y}} END FROM (
    SELECT *, CASE WHEN NOT bad THEN {{'x': x, 'y': y}} WHEN {_d('best', 'mid')} < 40 THEN best END AS got FROM (
      SELECT *, LIST_REDUCE(cs, lambda acc, opt: CASE WHEN {_d('opt', 'mid')} < {_d('acc', 'mid')} THEN opt ELSE acc END) AS best FROM (
        SELECT t.*, s.p, {{'x': (s.p.x + nx[1].x) / 2, 'y': (s.p.y + nx[1].y) / 2}} AS mid,
          COALESCE({_d('t', 's.p')} / (t.frame - s.p.f) > 40 AND {_d('t', 'nx[1]')} / (nx[1].f - t.frame) > 40 AND {_d('s.p', 'nx[1]')} / (nx[1].f - s.p.f) < 40, FALSE) AS bad
        FROM s JOIN t ON t.session_id = s.session_id AND t.camera = s.camera AND t.i = s.i + 1) a) b) c)
SELECT session_id, camera, frame, ROUND(got.x, 5) AS px, ROUND(got.y, 5) AS py FROM s WHERE got IS NOT NULL""")
def _(spark, sf):
    return out(S.velocity_outliers(mixed(spark, sf), table(spark, sf, "cands"), max_v=40.0))


@query("w42_anchor_reselection", f"""WITH RECURSIVE {_MIXED.format(ahead=23)},
an AS (SELECT session_id, camera, frame, i, x, y, cs, LIST_BOOL_OR(LIST_TRANSFORM(cs, lambda c: {_d('c', 't')} < 5)) AS anchor FROM t),
u AS (SELECT *, LIST({{'i': i, 'f': frame, 'x': x, 'y': y}}) FILTER (anchor) OVER (PARTITION BY session_id, camera ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 23 FOLLOWING) AS nx FROM an),
s AS (SELECT DISTINCT session_id, camera, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS STRUCT(x DOUBLE, y DOUBLE)) AS got, CAST([] AS STRUCT(i BIGINT, f BIGINT, x DOUBLE, y DOUBLE)[]) AS ps FROM t
  UNION ALL SELECT session_id, camera, i, frame, got, CASE WHEN anchor THEN LIST_APPEND(ps, {{'i': i, 'f': frame, 'x': got.x, 'y': got.y}})[-26:] ELSE ps END FROM (
    SELECT *, CASE WHEN g IS NOT NULL AND {_d('b', 'g')} >= 15 AND {_d('best', 'g')} < {_d('b', 'g')} - 15 THEN best ELSE {{'x': x, 'y': y}} END AS got FROM (
      SELECT *, LIST_REDUCE(cs, lambda acc, opt: CASE WHEN {_d('opt', 'g')} < {_d('acc', 'g')} THEN opt ELSE acc END) AS best FROM (
        SELECT *, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN {{'x': p.x * (1 - w) + n.x * w, 'y': p.y * (1 - w) + n.y * w}}
          WHEN p IS NOT NULL AND p2 IS NOT NULL THEN {{'x': p.x + (p.x - p2.x) / (p.f - p2.f) * (frame - p.f), 'y': p.y + (p.y - p2.y) / (p.f - p2.f) * (frame - p.f)}} WHEN p IS NOT NULL THEN {{'x': p.x, 'y': p.y}}
          WHEN n IS NOT NULL AND n2 IS NOT NULL THEN {{'x': n.x + (n2.x - n.x) / (n2.f - n.f) * (frame - n.f), 'y': n.y + (n2.y - n.y) / (n2.f - n.f) * (frame - n.f)}} WHEN n IS NOT NULL THEN {{'x': n.x, 'y': n.y}} END AS g FROM (
          SELECT *, CAST(frame - p.f AS DOUBLE) / (n.f - p.f) AS w, CASE WHEN ps[-2].i >= p.i - 10 THEN ps[-2] END AS p2, CASE WHEN nx[2].i < n.i + 10 THEN nx[2] END AS n2 FROM (
            SELECT u.*, LIST_FILTER(s.ps, lambda e: e.i >= u.i - 25) AS ps, CASE WHEN s.ps[-1].i >= u.i - 15 THEN s.ps[-1] END AS p, CASE WHEN nx[1].i < u.i + 15 THEN nx[1] END AS n
            FROM s JOIN u ON u.session_id = s.session_id AND u.camera = s.camera AND u.i = s.i + 1) a) b) c) b) d)
SELECT session_id, camera, frame, ROUND(got.x, 5) AS px, ROUND(got.y, 5) AS py FROM s WHERE got IS NOT NULL""")
def _(spark, sf):
    return out(S.reselect_by_anchors(mixed(spark, sf), table(spark, sf, "cands")))


def _xy(side, k):
    return f"LIST_TRANSFORM({side}, lambda e: e.{k})"


def _var(side):
    return f"CASE WHEN LEN({side}) >= 2 THEN LIST_VAR_POP({_xy(side, 'x')}) + LIST_VAR_POP({_xy(side, 'y')}) END"


_SIDE = "CASE WHEN va IS NULL THEN NULL WHEN vp IS NOT NULL AND (vn IS NULL OR vp <= vn) AND vp <= va THEN bp WHEN vn IS NOT NULL AND vn <= va THEN bn ELSE LIST_CONCAT(bp, bn) END"


@query("w42_side_reselection", f"""WITH RECURSIVE {_MIXED.format(ahead=5)},
s AS (SELECT DISTINCT session_id, camera, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS STRUCT(x DOUBLE, y DOUBLE)) AS got, CAST([] AS STRUCT(f BIGINT, x DOUBLE, y DOUBLE, i INTEGER)[]) AS ps FROM t
  UNION ALL SELECT session_id, camera, i, frame, got, LIST_APPEND(ps, {{'f': frame, 'x': got.x, 'y': got.y, 'i': 0}})[-5:] FROM (
    SELECT *, CASE WHEN m.x IS NULL THEN {{'x': x, 'y': y}} ELSE LIST_REDUCE(LIST_PREPEND({{'x': x, 'y': y}}, cs), lambda acc, opt: CASE WHEN {_d('opt', 'm')} < {_d('acc', 'm')} - 20 THEN opt ELSE acc END) END AS got FROM (
      SELECT *, {{'x': LIST_MEDIAN({_xy('side', 'x')}), 'y': LIST_MEDIAN({_xy('side', 'y')})}} AS m FROM (
        SELECT *, {_SIDE} AS side FROM (
          SELECT *, {_var('bp')} AS vp, {_var('bn')} AS vn, {_var('LIST_CONCAT(bp, bn)')} AS va FROM (
            SELECT t.*, s.ps, LIST_FILTER(s.ps, lambda e: t.frame - e.f <= 15) AS bp, COALESCE(LIST_FILTER(t.nx, lambda e: e.f - t.frame <= 15), []) AS bn
            FROM s JOIN t ON t.session_id = s.session_id AND t.camera = s.camera AND t.i = s.i + 1) a) b) c) d) e)
SELECT session_id, camera, frame, ROUND(got.x, 5) AS px, ROUND(got.y, 5) AS py FROM s WHERE got IS NOT NULL""")
def _(spark, sf):
    return out(S.reselect_by_sides(mixed(spark, sf), table(spark, sf, "cands")))


@query("w40_w43_clean_chain")
def _(spark, sf):
    c = table(spark, sf, "cands")
    d = S.median_outliers(S.median_outliers(table(spark, sf, "det"), c, max_px=150.0), c, half=3, max_px=100.0)
    return out(S.fill_quadratic(d, max_gap=5).unionByName(d.select("session_id", "camera", "frame", "pixel_x", "pixel_y")))


@query("w44_static_suppression", """
WITH c AS (SELECT session_id, camera, CAST(FLOOR(pixel_x / 40) AS BIGINT) AS cx, CAST(FLOOR(pixel_y / 40) AS BIGINT) AS cy, frame, rank FROM cands),
n AS (SELECT session_id, camera, cx, cy, frame, COUNT(*) AS n FROM c GROUP BY session_id, camera, cx, cy, frame),
h AS (SELECT a.session_id, a.camera, a.cx, a.cy, a.frame, SUM(b.n * POW(0.98, a.frame - b.frame)) AS heat FROM n a
  JOIN n b ON b.session_id = a.session_id AND b.camera = a.camera AND b.cx = a.cx AND b.cy = a.cy AND b.frame <= a.frame GROUP BY a.session_id, a.camera, a.cx, a.cy, a.frame)
SELECT c.session_id, c.camera, c.frame, c.rank, ROUND(heat, 5) AS heat, heat < 2 AS kept FROM c JOIN h USING (session_id, camera, cx, cy, frame)""")
def _(spark, sf):
    t = S.drop_static(table(spark, sf, "cands"), limit=2.0)
    return t.select("session_id", "camera", "frame", "rank", r("heat", 5).alias("heat"), "kept")


_NEAR = "CASE WHEN SQRT((c.x - s.p.x) * (c.x - s.p.x) + (c.y - s.p.y) * (c.y - s.p.y)) <= 80 * (u.frame - s.p.f) THEN 1 - SQRT((c.x - s.p.x) * (c.x - s.p.x) + (c.y - s.p.y) * (c.y - s.p.y)) / (80 * (u.frame - s.p.f)) ELSE 0 END * 0.7 + c.k * 0.3"


@query("w45_pick_by_proximity", f"""WITH RECURSIVE u AS (SELECT session_id, camera, frame, cs, ROW_NUMBER() OVER (PARTITION BY session_id, camera ORDER BY frame) AS i FROM (
    SELECT session_id, camera, frame, LIST({{'r': rank, 'x': pixel_x, 'y': pixel_y, 'k': CAST((event_id * 7 + rank * 3) % 10 AS DOUBLE) / 10}} ORDER BY rank) AS cs FROM cands GROUP BY session_id, camera, frame) a),
s AS (SELECT session_id, camera, i, cs[1].r AS rank, {{'f': frame, 'x': cs[1].x, 'y': cs[1].y}} AS p FROM u WHERE i = 1
  UNION ALL SELECT session_id, camera, i, b.r, {{'f': frame, 'x': b.x, 'y': b.y}} FROM (
    SELECT u.session_id, u.camera, u.i, u.frame, CASE WHEN u.frame - s.p.f > 5 THEN {{'r': cs[1].r, 'x': cs[1].x, 'y': cs[1].y, 'k': CAST(0 AS DOUBLE)}}
      ELSE LIST_REDUCE(LIST_TRANSFORM(cs, lambda c: {{'r': c.r, 'x': c.x, 'y': c.y, 'k': {_NEAR}}}), lambda a, c: CASE WHEN c.k > a.k THEN c ELSE a END) END AS b
    FROM s JOIN u ON u.session_id = s.session_id AND u.camera = s.camera AND u.i = s.i + 1) q)
SELECT session_id, camera, p.f AS frame, CAST(rank AS BIGINT) AS rank, ROUND(p.x, 5) AS px, ROUND(p.y, 5) AS py FROM s""")
def _(spark, sf):
    c = table(spark, sf, "cands").withColumn("conf", ((F.col("event_id") * 7 + F.col("rank") * 3) % 10).cast("double") / 10)
    return out(S.pick_by_proximity(c), "rank")


@query("p11_confidence_and_rays", _tri_sql("""SELECT d.session_id, d.frame, ROUND(d.pixel_x, 5) AS px FROM det66 d
JOIN (SELECT session_id, QUANTILE_CONT(blob_sum, 0.25) AS q25, QUANTILE_CONT(blob_sum, 0.5) AS q50 FROM det66 GROUP BY session_id) q ON q.session_id = d.session_id
LEFT JOIN tri ON tri.session_id = d.session_id AND tri.frame = d.frame
WHERE d.blob_sum >= q25 AND (tri.rd < 2.0 OR (tri.rd IS NULL AND d.blob_sum >= q50))"""))
def _(spark, sf):
    from .geometry import paired
    from ..functions.geometry import triangulated

    d = table(spark, sf, "det66")
    rays = triangulated(paired(spark, sf), "a", "b", CAM_A, CAM_B).select("session_id", "frame", "ray_dist")
    q = quantiles(d, ["session_id"], "blob_sum", {"q25": 0.25, "q50": 0.5})
    t = d.join(q, "session_id").where("blob_sum >= q25").join(rays, ["session_id", "frame"], "left")
    return t.where((F.col("ray_dist") < 2.0) | (F.col("ray_dist").isNull() & (F.col("blob_sum") >= F.col("q50")))).select(
        "session_id", "frame", r("pixel_x", 5).alias("px"))


def _w39_sql() -> str:
    def matrix(k):
        return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in S.sg_matrix(k, 2)) + "]"

    def sg(c, k):
        base = f"GREATEST(LEAST(i - {k // 2}, n - {k}), 0)"
        return f"LIST_SUM(LIST_TRANSFORM(RANGE(1, {k + 1}), lambda k: ({matrix(k)})[i - {base} + 1][k] * l{c}[{base} + k]))"

    def med(c, h):
        k = 2 * h + 1
        return f"LIST_SORT(LIST_CONCAT(l{c}[GREATEST(i - {h - 1}, 1):i + {h + 1}], LIST_TRANSFORM(RANGE({k} - LEN(l{c}[GREATEST(i - {h - 1}, 1):i + {h + 1}])), lambda q: CAST(0 AS DOUBLE))))[{h + 1}]"

    cols, parts = [], "SUM(u * {c}) OVER g / (n * (n * n - 1) / 12.0) * u"
    for c in "xyz":
        cols.append(f"ROUND(CASE WHEN n >= 5 THEN {med(c, 2)} WHEN n >= 3 THEN {med(c, 1)} ELSE {c} END, 5) AS {c}_median")
        cols.append(f"ROUND(s{c}, 5) AS {c}_sg")
        quad = "" if c != "z" else " + SUM((u * u - (n * n - 1) / 12.0) * z) OVER g / (n * (n * n - 1) / 12.0 * (n * n - 4) / 15.0) * (u * u - (n * n - 1) / 12.0)"
        cols.append(f"ROUND(CASE WHEN n > {3 if c == 'z' else 2} THEN AVG({c}) OVER g + {parts.format(c=c)}{quad} ELSE {c} END, 5) AS {c}_poly")
    smooth = ", ".join(f"CASE WHEN n >= 7 THEN {sg(c, 7)} WHEN n >= 5 THEN {sg(c, 5)} ELSE {c} END AS s{c}" for c in "xyz")
    return f"""
WITH a AS (SELECT session_id, frame, x, y, z, CASE WHEN frame - LAG(frame) OVER (PARTITION BY session_id ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS b FROM points),
b AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY frame) AS st FROM a),
c AS (SELECT *, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER g AS n, LIST(x) OVER v AS lx, LIST(y) OVER v AS ly, LIST(z) OVER v AS lz FROM b
  WINDOW w AS (PARTITION BY session_id, st ORDER BY frame), g AS (PARTITION BY session_id, st), v AS (PARTITION BY session_id, st ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CAST(i AS DOUBLE) - (n - 1) / 2.0 AS u, {smooth} FROM c)
SELECT session_id, frame, {", ".join(cols)}, SQRT((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) > 0.5 AS outlier FROM d WINDOW g AS (PARTITION BY session_id, st)"""


@query("w39_filter_comparison", _w39_sql())
def _(spark, sf):
    t = C.compare_filters(table(spark, sf, "points"))
    return t.withColumns({c: r(c, 5) for c in t.columns if c not in ("session_id", "frame", "outlier")})
