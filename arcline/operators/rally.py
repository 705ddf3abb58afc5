"""Rallies: window scoring, crossing sessions and point-by-point state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..court import COURT
from . import ordered
from .fold import fold
from .motion import crossed
from .ordered import neighbour, row_index, segments

KEYS = ["session_id"]
#: Cameras of a session at most.
CAMERAS = 16


def score_windows(rows: DataFrame, t0: DataFrame, length: float = 5.0, step: float = 0.5, min_rows: int = 5) -> DataFrame:
    """Score sliding windows on a grid from the first raw row; each row joins at most ten windows.

    A window holds a few seconds of frames, which bounds every partition below.
    """
    per = int(length / step)
    t = rows.join(t0, KEYS).withColumn("rt", F.col("t") - F.col("t0"))
    last = t.groupBy(*KEYS).agg(F.max("rt").alias("_dur"))
    hi = F.floor(F.col("rt") / step).cast("long")
    t = t.withColumn("wi", F.explode(F.sequence(F.greatest(hi - per + 1, F.lit(0).cast("long")), hi)))
    t = t.where((F.col("rt") >= F.col("wi") * step) & (F.col("rt") < F.col("wi") * step + length))
    t = t.join(last, KEYS).where(F.col("wi") * step + length <= F.col("_dur") + step)
    part = [*KEYS, "wi"]
    w = Window.partitionBy(*part).orderBy("rt")
    ys = F.when(F.count("*").over(w.rowsBetween(-4, 0)) == 5, F.avg("y").over(w.rowsBetween(-4, 0)))
    t = t.withColumns({"_ys": ys, "_gap": F.col("rt") - F.lag("rt").over(w), "_lv": F.when(F.col("z") > 1.0, 1).when(F.col("z") < 0.5, 0)})
    t = t.withColumns({"_dy": F.col("_ys") - F.lag("_ys").over(w), "_pl": F.last("_lv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    t = t.withColumn("_dir", F.when(F.abs("_dy") > 0.5, F.signum("_dy")))
    t = t.withColumn("_pd", F.last("_dir", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = t.groupBy(*part).agg(
        F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.count_if((F.col("_lv") == 0) & (F.col("_pl") == 1)).alias("arcs"), F.count_if(F.col("_dir") != F.col("_pd")).alias("turns"),
        (F.count_if(F.col("_gap") > 0.3) / F.greatest(F.count("*") - 1, F.lit(1))).alias("gaps"))
    score = (
        F.when((F.col("lo") < -2) & (F.col("hi") > 2), 2).otherwise(0) + F.when(F.col("hi") - F.col("lo") > 15, 3).otherwise(0)
        + F.least(F.col("arcs") * 2, F.lit(10)) + F.when(F.col("n") > 10, F.least(F.col("turns"), F.lit(8))).otherwise(0)
        + F.when(F.col("gaps") < 0.1, 2).otherwise(0))
    return s.where(F.col("n") >= min_rows).select(*part, score.alias("score"))


def scored_rallies(rows: DataFrame, t0: DataFrame, threshold: int = 12, length: float = 5.0, step: float = 0.5, merge: float = 3.0, min_s: float = 2.0) -> DataFrame:
    """Merge high windows whose starts are at most ``merge`` seconds apart."""
    high = score_windows(rows, t0, length, step).where(F.col("score") >= threshold)
    s = segments(high, KEYS, "wi", int(merge / step), "_seg")
    r = s.groupBy(*KEYS, "_seg").agg((F.min("wi") * step).alias("start_s"), (F.max("wi") * step + length).alias("end_s"), F.max("score").alias("peak_score"))
    r = row_index(r.where(F.col("end_s") - F.col("start_s") >= min_s), KEYS, "_seg", "rally")
    return r.select(*KEYS, (F.col("rally") + 1).alias("rally"), "start_s", "end_s", "peak_score")


def crossing_rallies(points: DataFrame, bounces: DataFrame, timeout: float = 3.0, fps: float = 25.0) -> DataFrame:
    """A rally runs from the first net crossing of a gap-free stretch to its last point.

    The step over a gap still counts as a crossing, so the previous row is taken at any distance.
    """
    c = neighbour(points.select(*KEYS, "frame", "t", "y"), KEYS, "frame", prev={"_py": (None, F.col("y"))})
    c = c.withColumn("_x", F.coalesce(crossed(F.col("_py"), F.col("y")), F.lit(False)))
    s = segments(c, KEYS, "frame", int(timeout * fps), "_seg").join(bounces.select(*KEYS, "frame", F.lit(1).alias("_b")), [*KEYS, "frame"], "left")
    first = s.where("_x").groupBy(*KEYS, "_seg").agg(F.min("frame").alias("start_frame"), F.min("t").alias("start_t"), F.count("*").alias("strokes"))
    rows = s.join(first, [*KEYS, "_seg"]).where(F.col("frame") >= F.col("start_frame"))
    r = rows.groupBy(*KEYS, "start_frame").agg(
        F.max("frame").alias("end_frame"), F.first("strokes").alias("strokes"), F.count("_b").alias("bounces"),
        (F.max("t") - F.min("t")).alias("duration_s"))
    return row_index(r, KEYS, "start_frame", "rally").withColumn("rally", F.col("rally") + 1)


# ---- full rally state machine ---------------------------------------------------------------

POINT_SCHEMA = ("start_frame long, end_frame long, start_t double, end_t double, strokes long, bounces long, "
                "reason string, end_side string, server string")


def point_state() -> dict:
    return {"mode": "idle", "t": None, "yz": None, "ended": False, "pend": [], "rally": None}


def point_step(state: dict, row, timeout: float = 3.0, pause: float = 2.0, quick: float = 0.3, confirm: int = 3) -> list[tuple]:
    """Advance the point-play machine by one row (frame, t, y, z, ray_dist, b_x, b_y, b_in).

    Modes: idle, pending (collecting evidence), serving, rally. A rally record carries its own
    attempt, touch and bounce memory; leaving a mode drops it.
    """
    out: list[tuple] = []
    f, t, y, z = int(row.frame), float(row.t), float(row.y), float(row.z)
    half = "near" if y < COURT.net_y else "far"
    back = abs(y) > COURT.baseline_zone
    gap = t - state["t"] if state["t"] is not None else 0.0
    cold = state["t"] is None

    def begin(mode: str, server: str) -> None:
        p = state["pend"][0] if state["pend"] else [f, t, y]
        state["mode"], state["pend"], state["yz"] = mode, [], None
        state["rally"] = {"f": p[0], "t": p[1], "n": 0, "b": 0, "server": server, "attempt": 1, "touch": False, "await": False,
                          "last": "", "run": 0, "side": state.get("side", "")}

    def finish(reason: str, side: str = "") -> None:
        g = state["rally"]
        out.append((g["f"], f, g["t"], t, g["n"], g["b"], reason, side, g["server"]))
        state["side"] = g["side"]
        state.update(mode="idle", pend=[], rally=None, ended=True)

    def serve_again(attempt: int) -> None:
        state["rally"].update(attempt=attempt, touch=False, n=0, b=0, last="", run=0)
        state["rally"]["await"] = False
        state["mode"], state["yz"] = "serving", None

    def fault() -> None:
        if state["rally"]["attempt"] == 1:
            serve_again(2)
        else:
            finish("double_fault")

    if gap > timeout and state["mode"] == "rally":
        finish("timeout")
    elif gap > timeout and state["mode"] == "serving":
        fault()
    if state["mode"] == "pending" and gap > pause:
        state.update(mode="idle", pend=[])
    if state["mode"] == "idle" and (cold or gap > pause or (state["ended"] and back and gap >= quick)):
        state.update(mode="pending", pend=[], ended=False, yz=None)

    def over_net() -> bool:
        p = state["yz"]
        return p is not None and (p[0] < COURT.net_y) != (y < COURT.net_y)

    if state["mode"] == "pending":
        state["pend"].append([f, t, y])
        if over_net():
            begin("rally", "")
            state["rally"].update(n=1, side=half)
        elif len(state["pend"]) >= confirm:
            zone = sum(abs(p[2]) > COURT.baseline_zone for p in state["pend"])
            if zone > len(state["pend"]) // 2:
                begin("serving", "near" if state["pend"][0][2] < COURT.net_y else "far")
            else:
                begin("rally", "")
    g = state["rally"]
    if g is not None and over_net():
        if state["mode"] == "serving":
            state["mode"], g["await"] = "rally", True
        g.update(n=g["n"] + 1, run=0, side=half)
    p = state["yz"]
    if g is not None and p is not None and abs(y) < COURT.net_zone and p[1] - z > 0.3 and z < COURT.net_height and float(row.ray_dist) < 1.5:
        if state["mode"] == "rally" and not g["await"]:
            finish("net", g["side"])
        else:
            g["touch"] = True
    g = state["rally"]
    if g is not None and row.b_in is not None and row.b_in == row.b_in:
        bx, by, inside = float(row.b_x), float(row.b_y), bool(row.b_in)
        bside = "near" if by < COURT.net_y else "far"
        if state["mode"] == "serving":
            g["b"] += 1
            fault()
        elif g["await"]:
            g["await"] = False
            target = {"near": 0 < by < COURT.service_line, "far": -COURT.service_line < by < 0}.get(g["server"], False)
            if not (target and abs(bx) <= COURT.half_width):
                fault()
            elif g["touch"]:
                serve_again(g["attempt"])
            else:
                g.update(b=g["b"] + 1, last=bside, run=1)
        else:
            g["b"] += 1
            same = g["last"] == bside
            g.update(last=bside, run=g["run"] + 1 if same else 1)
            if not inside:
                finish("out", g["side"])
            elif same and g["run"] >= 2:
                finish("double_bounce", bside)
    state["yz"], state["t"] = [y, z], t
    return out


def points_played(points: DataFrame, bounces: DataFrame, **kw) -> DataFrame:
    """Run the point-play machine along each session. ``bounces``: session, frame, x, y, in_court."""
    b = bounces.select(*KEYS, "frame", F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("in_court").alias("b_in"))
    rows = points.select(*KEYS, "frame", "t", "y", "z", "ray_dist").join(b, [*KEYS, "frame"], "left")
    r = fold(rows, KEYS, "frame", point_state(), lambda s, row: point_step(s, row, **kw), POINT_SCHEMA)
    return row_index(r, KEYS, "start_frame", "rally").withColumn("rally", F.col("rally") + 1)


def frame_rallies(track: DataFrame, bounces: DataFrame, serve_rows: DataFrame, timeout: int = 75, pause: int = 15, ahead: int = 40, net_gap: int = 5) -> DataFrame:
    """Single-camera rallies by frame distances: serve or resume start; out, double bounce, timeout, ongoing.

    ``track``: session, frame, world_y. The next serve of each row is attached by an as-of scan.
    """
    from .joins import asof

    s = serve_rows.groupBy(*KEYS, "frame").agg(F.first("side").alias("side"))
    rows = asof(track.select(*KEYS, "frame", "world_y"), s, KEYS, "frame", forward={"sf": F.col("frame"), "ss": F.col("side")})
    b = bounces.select(*KEYS, "frame", F.col("side").alias("b_side"), F.col("in_court").alias("b_in"))
    rows = rows.join(b, [*KEYS, "frame"], "left")
    schema = "start_frame long, end_frame long, start_type string, reason string, serve_side string, bounces long, strokes long"

    def record(g, end, reason):
        return (g["f"], end, "serve" if g["serve"] else "resume", reason, g["serve"], g["b"], g["n"])

    def step(state, row):
        out, f, y = [], int(row.frame), float(row.world_y)
        last, g = state["f"], state["g"]
        idle = 999 if last is None else f - last
        if g and idle > timeout:
            if g["mode"] == "rally":
                out.append(record(g, last, "timeout"))
            g = None
        next_serve = int(row.sf) if row.sf is not None and row.sf == row.sf else None
        if g is None:
            new = {"f": f, "mode": "rally", "serve": "", "b": 0, "n": 0, "last": "", "run": 0}
            if next_serve == f:
                g = {**new, "mode": "serving", "serve": row.ss}
            elif idle > pause:
                g = {**new, "mode": "toss", "serve": row.ss} if next_serve is not None and next_serve <= f + ahead else new
        if g and g["mode"] == "toss" and next_serve == f:
            g.update(mode="serving", f=f)
        if g and last is not None and idle <= net_gap and (state["y"] < 0) != (y < 0):
            g.update(mode="rally", n=g["n"] + 1, run=0)
        if g and g["mode"] == "rally" and isinstance(row.b_side, str):
            same = row.b_side == g["last"]
            g.update(b=g["b"] + 1, run=g["run"] + 1 if same else 1, last=row.b_side)
            if not bool(row.b_in):
                out.append(record(g, f, "out"))
                g = None
            elif same and g["run"] >= 2:
                out.append(record(g, f, "double_bounce"))
                g = None
        state.update(f=f, y=y, g=g)
        return out

    def close(state):
        g = state["g"]
        return [record(g, state["f"], "ongoing")] if g and g["mode"] == "rally" else []

    return fold(rows, KEYS, "frame", {"f": None, "y": None, "g": None}, step, schema, flush=close)


# ---- window-of-rows landing detectors with restart after a hit -------------------------------

def _line(ts, zs):
    n, mt, mz = len(ts), sum(ts) / len(ts), sum(zs) / len(zs)
    v = sum((t - mt) ** 2 for t in ts)
    k = sum((t - mt) * (z - mz) for t, z in zip(ts, zs)) / v if v else 0.0
    return k, sum((z - mz - k * (t - mt)) ** 2 for t, z in zip(ts, zs))


def v_shape_bounces(points: DataFrame, size: int = 10, z_max: float = 0.5, cooldown: float = 0.3, gain: float = 0.3) -> DataFrame:
    """Two lines meeting near the ground explain the recent heights much better than one."""

    def step(state, row):
        t, w = float(row.t), state["w"]
        w.append([int(row.frame), t, float(row.x), float(row.y), float(row.z)])
        del w[:-size]
        if len(w) < 6 or (state["t"] is not None and t - state["t"] < cooldown):
            return []
        ts, zs = [p[1] for p in w], [p[4] for p in w]
        one = _line(ts, zs)[1]
        if one < 1e-10:
            return []
        fits = []
        for k in range(2, len(w) - 2):
            (a, ra), (b, rb) = _line(ts[: k + 1], zs[: k + 1]), _line(ts[k:], zs[k:])
            fits.append((ra + rb, k, a, b))
        two, k, a, b = min(fits)
        if not (1 - two / one > gain and zs[k] < z_max and a < 0 < b):
            return []
        state["t"], state["w"] = t, w[k + 1:]
        return [(w[k][0], *w[k][2:], min(1.0, 1 - two / one))]

    return fold(points.select(*KEYS, "frame", "t", "x", "y", "z"), KEYS, "frame", {"w": [], "t": None}, step,
                "frame long, x double, y double, z double, confidence double")


def dip_bounces(points: DataFrame, landing: DataFrame | None = None, size: int = 8, z_max: float = 0.8, cooldown: int = 5, noise: float = 0.15, dip: float = 0.1) -> DataFrame:
    """Descend-then-rise dips in the last few heights.

    ``landing`` has the preferred ground position per frame (see ``landing_positions``).
    """

    def step(state, row):
        f, w = int(row.frame), state["w"]
        w.append([f, float(row.x), float(row.y), float(row.z)])
        del w[:-size]
        if state["f"] is not None and f - state["f"] < cooldown or len(w) < 4:
            return []
        z = [p[3] for p in w]
        ok = [k for k in range(2, len(z) - 1)
              if z[k - 2] >= z[k - 1] - noise and z[k - 1] >= z[k] - noise and z[k] <= z[k + 1] + noise]
        if not ok:
            return []
        k = min(ok, key=lambda i: (z[i], i))
        if z[k] > z_max or z[k] > min(z[k - 2], z[k + 1]) - dip:
            return []
        depth = min(1.0, min(z[k - 2], z[min(len(z) - 1, k + 2)]) - z[k])
        conf = round(min(1.0, 0.7 * depth + 0.3 * min(1.0, len(z) / 6.0)), 3)
        state["f"], state["w"] = f, w[k + 1:]
        return [(w[k][0], f, *w[k][1:], conf)]

    b = fold(points.select(*KEYS, "frame", "x", "y", "z"), KEYS, "frame", {"w": [], "f": None}, step,
             "frame long, seen_at long, x double, y double, z double, confidence double")
    if landing is None:
        return b
    j = b.join(landing.select(*KEYS, "frame", "land_x", "land_y", "source"), [*KEYS, "frame"], "left")
    return j.withColumns({"x": F.coalesce("land_x", "x"), "y": F.coalesce("land_y", "y"), "source": F.coalesce("source", F.lit("3d"))}).drop("land_x", "land_y")


def landing_positions(points: DataFrame, a: DataFrame, b: DataFrame, rows: int = 2, gap: int = 25) -> DataFrame:
    """Ground position per frame: the surer camera, else the mean of camera rows within ``rows``
    rows, else the 3-D point itself."""
    from .ordered import windowed

    def cam(d: DataFrame, n: str) -> DataFrame:
        return d.select(*KEYS, "frame", F.struct(F.col("blob_sum").alias("c"), F.col("world_x").alias("x"), F.col("world_y").alias("y")).alias(n))

    t = points.select(*KEYS, "frame", "x", "y").join(cam(a, "a"), [*KEYS, "frame"], "left").join(cam(b, "b"), [*KEYS, "frame"], "left")
    t = row_index(t, KEYS, "frame")
    va, vb = F.col("a"), F.col("b")

    def mean_of(t: DataFrame, w) -> DataFrame:
        near = [w.rowsBetween(-rows, -1), w.rowsBetween(1, rows)]
        tot = lambda c: sum((F.coalesce(F.sum(v[c]).over(x), F.lit(0.0)) for x in near for v in (va, vb)), F.lit(0.0))
        n = sum((F.count(v["x"]).over(x) for x in near for v in (va, vb)), F.lit(0))
        return t.withColumns({"_n": n, "_sx": tot("x"), "_sy": tot("y")})

    t = windowed(t, KEYS, "idx", mean_of, rows, rows)
    best = F.when(va.isNotNull() & (vb.isNull() | (va["c"] >= vb["c"])), va).otherwise(vb)
    src = F.when(best.isNull(), F.when(F.col("_n") > 0, "interpolated").otherwise("3d")).when(va.isNotNull() & (vb.isNull() | (va["c"] >= vb["c"])), "cam66").otherwise("cam68")
    pick = lambda c: F.coalesce(best[c], F.try_divide(F.col(f"_s{c}"), F.col("_n")), F.col(c))
    return t.select(*KEYS, "frame", pick("x").alias("land_x"), pick("y").alias("land_y"), src.alias("source"))


def single_camera_bounces(det: DataFrame, keep: int = 20, prominence: float = 15.0, rows: int = 5, cooldown: int = 8, jump: float = 150.0, gap: int = 3) -> DataFrame:
    """Image-height peaks in the recent gap-free rows of each camera, confirmed by one later row; one cooldown for all cameras.

    Cameras of one frame go by name.
    """
    from .peaks import peak_positions

    cams = [r[0] for r in det.select("camera").distinct().orderBy("camera").limit(CAMERAS + 1).collect()]
    if len(cams) > CAMERAS:
        raise ValueError(f"more than {CAMERAS} cameras")
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in cams]) if cams else F.array().cast("array<string>"), F.col("camera")) - 1, F.lit(0))
    rows_in = det.select("session_id", (F.col("frame") * CAMERAS + place).alias("at"), "camera", "frame", "pixel_y", "world_x", "world_y")

    def step(state, row):
        f, y, cam = int(row.frame), float(row.pixel_y), row.camera
        w = state["w"].setdefault(cam, [])
        if w and abs(y - w[-1][1]) > jump * max(1, f - w[-1][0]):
            return []
        if w and f - w[-1][0] > gap:
            w.clear()
        w.append([f, y, float(row.world_x), float(row.world_y)])
        del w[:-keep]
        last = state["f"]
        if len(w) < 7 or (last is not None and f - last < cooldown):
            return []
        hits = [i for i in peak_positions([p[1] for p in w], rows, prominence) if i <= len(w) - 2 and (last is None or w[i][0] - last >= cooldown)]
        if not hits:
            return []
        p = w[max(hits)]
        state["f"] = p[0]
        return [(cam, p[0], p[2], p[3], "near" if p[3] < 0 else "far")]

    return fold(rows_in, KEYS, "at", {"w": {}, "f": None}, step, "camera string, frame long, x double, y double, side string", block=CAMERAS * ordered.BLOCK)


def accepted_bounces(bounces: DataFrame, dup_s: float = 0.7, dup_m: float = 1.0, min_s: float = 0.4, min_m: float = 2.0) -> DataFrame:
    """Give each reported landing a verdict against the last five accepted ones."""

    def step(state, row):
        t, x, y = float(row.t), float(row.x), float(row.y)
        side = "near" if y < 0 else "far"
        dist = lambda p: ((x - p[1]) ** 2 + (y - p[2]) ** 2) ** 0.5
        acc = state["a"]
        verdict = "accepted"
        if any(0 <= t - p[0] <= dup_s and dist(p) < dup_m for p in acc):
            verdict = "duplicate"
        elif acc and 0 <= t - acc[-1][0] < min_s and acc[-1][3] == side and dist(acc[-1]) < min_m:
            verdict = "f2_min_interval"
        else:
            state["a"] = [*acc, [t, x, y, side]][-5:]
        return [(int(row.frame), verdict)]

    return fold(bounces.select(*KEYS, "frame", "t", "x", "y"), KEYS, "frame", {"a": []}, step, "frame long, verdict string")
