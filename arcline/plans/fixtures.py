"""Sensor tables derived from the given tables by plain projections.

Each text runs unchanged on Spark and on any ANSI engine. No window, sort or filter by id is
involved, so the derivation is one scan at any scale and every event row is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Two cameras behind the baselines (metres).
CAM_A = (0.0, -20.0, 8.0)
CAM_B = (2.0, 22.0, 7.5)

_T = {}

# The small decimal offsets keep values off rounding ties, where engines may differ.
_T["ev_base"] = """
SELECT event_id, user_id, ts, event_type, value,
       CAST(FLOOR(CAST(event_id AS DOUBLE) / 512) AS BIGINT) AS session_id,
       event_id % 512 AS k
FROM events"""

# one ball position per frame; gaps of 2, 7 and 47+ frames come from the frame formula
_T["points"] = """
SELECT session_id, frame, event_id, ts, event_type, value,
       CAST(frame AS DOUBLE) / 25 AS t,
       CAST(ABS((frame + 11 * session_id) % 90 - 45) - 22 AS DOUBLE) / 4 + 0.0012131 AS x,
       CAST(ABS(frame % 40 - 20) - 10 AS DOUBLE) * 1.25 + CAST((event_id * 37) % 11 - 5 AS DOUBLE) / 64 + 0.0007919 AS y,
       0.0637213 + CAST(ABS((frame + 3 * session_id) % 20 - 10) * ABS((frame + 3 * session_id) % 20 - 10) AS DOUBLE) / 64
              + CAST((event_id * 53) % 7 AS DOUBLE) / 256 AS z,
       CAST((event_id * 17) % 40 AS DOUBLE) / 16 + 0.0003713 AS ray_dist
FROM (SELECT session_id, event_id, ts, event_type, value,
             k + CAST(FLOOR(CAST(k AS DOUBLE) / 7) AS BIGINT) + 6 * CAST(FLOOR(CAST(k AS DOUBLE) / 25) AS BIGINT)
               + 40 * CAST(FLOOR(CAST(k AS DOUBLE) / 128) AS BIGINT) AS frame
      FROM ev_base) f"""

# ground projection of the ball through each camera, then pixels; each camera misses some frames
_T["det"] = """
SELECT session_id, camera, frame, event_id, ts, event_type, t, world_x, world_y,
       (960 + 64 * world_x + 2 * world_y) / (1 + world_y / 128) AS pixel_x,
       (540 - 24 * sgn * world_y + world_x) / (1 + world_y / 128) AS pixel_y,
       value AS blob_sum
FROM (SELECT session_id, 'cam66' AS camera, frame, event_id, ts, event_type, t, value, 1 AS sgn,
             {ax} + (x - {ax}) * {az} / ({az} - z) AS world_x,
             {ay} + (y - {ay}) * {az} / ({az} - z) AS world_y
      FROM points WHERE event_type <> 'error'
      UNION ALL
      SELECT session_id, 'cam68' AS camera, frame, event_id, ts, event_type, t, value, -1 AS sgn,
             {bx} + (x - {bx}) * {bz} / ({bz} - z) AS world_x,
             {by} + (y - {by}) * {bz} / ({bz} - z) AS world_y
      FROM points WHERE event_type <> 'signup') g""".format(
    ax=CAM_A[0], ay=f"({CAM_A[1]})", az=CAM_A[2], bx=CAM_B[0], by=CAM_B[1], bz=CAM_B[2]
)
_T["det66"] = "SELECT * FROM det WHERE camera = 'cam66'"
_T["det68"] = "SELECT * FROM det WHERE camera = 'cam68'"

# ranked candidate blobs: the ball plus two decoys
_T["cands"] = """
SELECT d.session_id, d.camera, d.frame, d.event_id, r.rank,
       d.pixel_x + CAST((d.event_id * 7 + r.rank * 13) % 41 - 20 AS DOUBLE) * r.rank * 4 AS pixel_x,
       d.pixel_y + CAST((d.event_id * 11 + r.rank * 5) % 37 - 18 AS DOUBLE) * r.rank * 4 AS pixel_y,
       d.world_x + CAST((d.event_id * 7 + r.rank * 13) % 41 - 20 AS DOUBLE) * r.rank / 16 AS world_x,
       d.world_y + CAST((d.event_id * 11 + r.rank * 5) % 37 - 18 AS DOUBLE) * r.rank / 16 AS world_y,
       d.blob_sum / (1 + r.rank) AS blob_sum
FROM det d CROSS JOIN (SELECT 0 AS rank UNION ALL SELECT 1 AS rank UNION ALL SELECT 2 AS rank) r"""

# two event lists that contend for the same partners
_T["gt_events"] = "SELECT session_id, frame, x, y, z, t FROM points WHERE event_type = 'purchase'"
_T["det_events"] = """
SELECT session_id, frame, x + CAST((event_id * 7) % 9 - 4 AS DOUBLE) / 8 AS x, y, z, t, value AS conf
FROM points WHERE event_type = 'click'"""

# human-annotated pixel positions of camera 66
_T["gt_px"] = """
SELECT session_id, frame,
       pixel_x + CAST((event_id * 31) % 79 - 39 AS DOUBLE) AS pixel_x,
       pixel_y + CAST((event_id * 43) % 61 - 30 AS DOUBLE) AS pixel_y,
       event_type
FROM det WHERE camera = 'cam66' AND event_type <> 'view'"""

_T["play"] = """
SELECT session_id, frame, t AS ts, x, y, z, value + 0.00137 AS speed_kmh,
       event_type = 'purchase' AS is_bounce,
       event_type = 'click' AS is_hit,
       CASE WHEN event_type <> 'error' THEN x / 2 + CAST((event_id * 3) % 5 AS DOUBLE) / 32 END AS near_x,
       CASE WHEN event_type <> 'error' THEN -9 - CAST((event_id * 5) % 7 AS DOUBLE) / 32 END AS near_y,
       CASE WHEN event_type <> 'signup' THEN x / 4 - CAST((event_id * 3) % 5 AS DOUBLE) / 32 END AS far_x,
       CASE WHEN event_type <> 'signup' THEN 9 + CAST((event_id * 5) % 7 AS DOUBLE) / 32 END AS far_y,
       CAST((event_id * 7) % 13 AS DOUBLE) AS shoulder_x,
       CAST((event_id * 11) % 13 AS DOUBLE) AS wrist_x,
       CAST((event_id * 5) % 10 AS DOUBLE) / 10 AS wrist_conf
FROM points"""

# the same shape from the larger table; (order, line) repeats in the source, so it is grouped
_T["points_big"] = """
SELECT session_id, frame, CAST(frame AS DOUBLE) / 25 AS t,
       CAST(ABS((frame + 11 * session_id) % 90 - 45) - 22 AS DOUBLE) / 4 + 0.0012131 AS x,
       CAST(ABS(frame % 40 - 20) - 10 AS DOUBLE) * 1.25 + CAST((frame * 37) % 11 - 5 AS DOUBLE) / 64 + 0.0007919 AS y,
       0.0637213 + CAST(ABS((frame + 3 * session_id) % 20 - 10) * ABS((frame + 3 * session_id) % 20 - 10) AS DOUBLE) / 64
              + CAST((frame * 53) % 7 AS DOUBLE) / 256 AS z,
       CAST((frame * 17) % 40 AS DOUBLE) / 16 + 0.0003713 AS ray_dist, value
FROM (SELECT CAST(FLOOR(CAST(l_orderkey AS DOUBLE) / 2048) AS BIGINT) AS session_id,
             (l_orderkey % 2048) * 8 + l_linenumber AS frame, MAX(l_quantity) AS value
      FROM lineitem GROUP BY l_orderkey, l_linenumber) b"""

_GIVEN = ("events", "lineitem", "orders", "supplier", "nation")
_NAMES = re.compile(r"\b(" + "|".join([*_T, *_GIVEN]) + r")\b(?=\s|$|\))")
_FROM = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join([*_T, *_GIVEN]) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a sensor table derived from it."""
    if name not in _T:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {m.group(2) for m in _FROM.finditer(_T[name])}
    text = _FROM.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", _T[name])
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n in _T and n not in seen:
            _closure([m.group(2) for m in _FROM.finditer(_T[n])], seen)
            seen.append(n)
    return seen


def oracle(body: str) -> str:
    """Prefix a query with the derivations it mentions; the body may begin with its own WITH."""
    used = [n for n in _T if re.search(rf"\b{n}\b", body)]
    views = [f"{n} AS ({_T[n]})" for n in _closure(used, [])]
    body = body.strip()
    low = body.lower()
    rec = low.startswith("with recursive ")
    if low.startswith("with "):
        body = body[len("with recursive "):] if rec else body[len("with "):]
        return "WITH " + ("RECURSIVE " if rec else "") + ",\n".join([*views, body])
    return ("WITH " + ",\n".join(views) + "\n" + body) if views else body


def _camera_rows() -> list[tuple]:
    import numpy as np

    rows = []
    for name, sgn, pos in (("cam66", 1, CAM_A), ("cam68", -1, CAM_B)):
        g = np.array([[64.0, 2.0, 960.0], [1.0, -24.0 * sgn, 540.0], [0.0, 1 / 128, 1.0]])
        h = np.linalg.inv(g)
        rows.append((name, *[float(v) for v in h.ravel()], *[float(v) for v in g.ravel()], *pos))
    return rows


CAMERA_COLS = ["camera"] + [f"{m}{i}{j}" for m in "hg" for i in range(3) for j in range(3)] + ["pos_x", "pos_y", "pos_z"]
CAMERAS = _camera_rows()
_T["cams"] = " UNION ALL ".join(
    "SELECT " + ", ".join(f"'{v}' AS {c}" if c == "camera" else f"CAST({v!r} AS DOUBLE) AS {c}" for c, v in zip(CAMERA_COLS, row))
    for row in CAMERAS
)
