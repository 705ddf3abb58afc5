"""Live rules: what one row does to a bounded memory. Each runs on a stream by ``inorder.in_order`` and over a list by ``one_pass``.

Times are seconds of capture. A row without a frame only says that time went on.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import numpy as np

from ..court import COURT, FPS
from ..operators import rally as R
from ..operators.peaks import peak_positions
from ..operators.smooth import sg_matrix
from .inorder import Rule


def one_pass(rule: Rule, rows: Iterable, at=lambda r: r.t, end: bool = True) -> list[tuple]:
    """The rule over rows in order, as a stream without end sees them."""
    state, out = json.loads(json.dumps(rule.init)), []
    last = None
    for r in rows:
        while rule.deadline and (d := rule.deadline(state)) is not None and at(r) > d:
            out += rule.expire(state)
        out += rule.step(state, r)
        last = r
    while end and last is not None and rule.deadline and rule.deadline(state) is not None:
        out += rule.expire(state)
    return out


def _none(v) -> bool:
    return v is None or v != v


# ---- pairing two cameras by nearest time -----------------------------------------------------

def pairing(window: float = 2.0, cols: Sequence[str] = ("world_x", "world_y", "pixel_x", "pixel_y", "blob_sum")) -> Rule:
    """Rows of camera ``a`` in time order take the nearest row of ``b`` within the window that is still free.

    A row of ``a`` waits until no nearer partner can come; rows of ``b`` wait while any ``a`` can still take them.
    """
    schema = "frame long, b_frame long, a_t double, b_t double, " + ", ".join(f"{s}_{c} double" for s in "ab" for c in cols)

    def decide(state: dict) -> list[tuple]:
        a = state["a"].pop(0)
        near = min((abs(b[0] - a[0]), b[0], i) for i, b in enumerate(state["b"])) if state["b"] else (window,)
        out = []
        if near[0] < window:
            b = state["b"].pop(near[2])
            out = [(a[1], b[1], a[0], b[0], *a[2], *b[2])]
        low = state["a"][0][0] if state["a"] else a[0]
        state["b"] = [b for b in state["b"] if b[0] > low - window]
        return out

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        out, t = [], float(row.t)
        while state["a"] and state["a"][0][0] + window <= t:
            out += decide(state)
        state[row.side].append([t, int(row.frame), [float(getattr(row, c)) for c in cols]])
        if row.side == "b" and not state["a"]:
            state["b"] = [b for b in state["b"] if b[0] > t - window]
        return out

    return Rule(schema, {"a": [], "b": []}, step, lambda s: s["a"][0][0] + window if s["a"] else None, decide, ties=("t", "side", "frame"))


# ---- repeated pairs and weak pairs -----------------------------------------------------------

def gate(percentile: float = 20, size: int = 500, every: int = 50) -> Rule:
    """Drops a pair with the pixels of the last accepted one, and pairs below a percentile of recent confidence.

    The threshold is renewed when the history's length is a multiple of ``every``; a full history stays one.
    """

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        quad = [float(v) for v in (row.a_pixel_x, row.a_pixel_y, row.b_pixel_x, row.b_pixel_y)]
        if quad == state["q"]:
            return []
        conf = (float(row.a_blob_sum) + float(row.b_blob_sum)) / 2
        hist, ranked = state["h"], state["r"]
        hist.append(conf)
        insort(ranked, conf)
        if len(hist) > size:
            del ranked[bisect_left(ranked, hist.pop(0))]
        if len(hist) >= every and len(hist) % every == 0:
            state["th"] = ranked[int(len(hist) * percentile / 100)]
        if conf < state["th"]:
            return []
        state["q"] = quad
        return [(int(row.frame), float(row.a_t), conf, state["th"])]

    return Rule("frame long, t double, conf double, threshold double", {"q": None, "h": [], "r": [], "th": 0.0}, step, ties=("a_t", "frame"))


# ---- smoothing, crossings --------------------------------------------------------------------

_CAMS = ("a_x", "a_y", "a_conf", "b_x", "b_y", "b_conf")


class _Smoother:
    """The row ``window // 2`` back by a polynomial over the last ``window`` rows without a pause; raw rows until there are as many."""

    def __init__(self, window: int = 11, order: int = 3, pause: float = 0.2):
        self.window, self.pause = window, pause
        self.weights = [float(v) for v in sg_matrix(window, order)[window // 2]]

    def push(self, ring: list, row: list) -> tuple[list, bool]:
        """``row``: frame, t, x, y, z. Returns the row to hand on and whether it is smoothed."""
        if ring and row[1] - ring[-1][1] > self.pause:
            ring.clear()
        ring.append(row)
        del ring[: -self.window]
        if len(ring) < self.window:
            return row, False
        mid = ring[self.window // 2]
        x, y, z = (sum(w * r[i] for w, r in zip(self.weights, ring)) for i in (2, 3, 4))
        return [mid[0], mid[1], x, y, max(z, 0.0)], True


def smoothing(window: int = 11, order: int = 3, pause: float = 0.2) -> Rule:
    """One row out for each row in: the smoothed one half a window back, or the row itself while a stretch is short."""
    s = _Smoother(window, order, pause)

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        out, smooth = s.push(state["w"], [int(row.frame), float(row.t), float(row.x), float(row.y), float(row.z)])
        return [(int(row.frame), *out, smooth)]

    def clear(state: dict) -> list[tuple]:
        state["w"] = []
        return []

    return Rule("at_frame long, frame long, t double, x double, y double, z double, smooth boolean", {"w": []}, step,
                lambda st: st["w"][-1][1] + pause if st["w"] else None, clear)


def motion(window: int = 11, order: int = 3, pause: float = 0.2, cap: float = 280.0, band: tuple[float, float] = (30.0, 150.0), keep: int = 5) -> Rule:
    """Typed rows of each point: a net crossing with the median of recent speeds, then the smoothed point.

    A point's camera columns go along with the row that is handed on at its time.
    """
    s = _Smoother(window, order, pause)
    schema = "seq int, kind string, seen double, frame long, t double, x double, y double, z double, speed long, direction string, " + ", ".join(f"{c} double" for c in _CAMS)

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        f, t, p, out = int(row.frame), float(row.t), [float(row.x), float(row.y), float(row.z)], []
        last = state["p"]
        if last is not None:
            dt = t - last[0]
            if dt > 0.001:
                v = sum((a - b) ** 2 for a, b in zip(p, last[1:])) ** 0.5 / dt * 3.6
                if v <= cap:
                    state["v"] = [*state["v"], v][-keep:]
            was, now, v = last[2], p[1], sorted(state["v"])
            if (was < COURT.net_y <= now or was > COURT.net_y >= now) and len(v) >= 2:
                mid = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
                if band[0] <= mid <= band[1]:
                    out.append((0, "crossing", t, f, t, *p, int(round(mid)), "near_to_far" if now > was else "far_to_near", *[None] * 6))
        state["p"] = [t, *p]
        r, _ = s.push(state["w"], [f, t, *p])
        return [*out, (1, "point", t, *r, None, None, *[None if _none(getattr(row, c)) else float(getattr(row, c)) for c in _CAMS])]

    def clear(state: dict) -> list[tuple]:
        state["w"] = []
        return []

    return Rule(schema, {"p": None, "v": [], "w": []}, step, lambda st: st["w"][-1][1] + pause if st["w"] else None, clear)


# ---- landings of smoothed points -------------------------------------------------------------

def _rest(ts: Sequence[float], zs: Sequence[float]) -> float:
    """Mean squared residual of the best parabola."""
    t, z = np.asarray(ts, float), np.asarray(zs, float)
    t = t - t.mean()
    s = np.abs(t).max() or 1.0
    v = np.vander(t / s, 3)
    return float(np.mean((z - v @ np.linalg.lstsq(v, z, rcond=None)[0]) ** 2))


def landings(size: int = 60, v_rows: int = 8, halves: tuple[int, ...] = (4, 6, 8), z_max: float = 0.8, least: int = 8, dense: int = 8, dense_reach: int = 12,
             min_speed: float = 3.0, span: int = 3, cooldown: float = 12 / FPS, pause: float = 0.6) -> Rule:
    """Landings among handed-on points: a V in the height, or a V and a better fit by two parabolas.

    The point judged is as many rows back as the widest look. The landing is the lowest row near it; its place is
    the surer camera's at that row, else the mean of cameras two rows around, else the point. Crossings pass.
    """
    m = max(*halves, v_rows)
    schema = "seq int, kind string, seen double, frame long, t double, x double, y double, z double, speed long, direction string, in_court boolean, confidence double, source string"

    def place(w: list, i: int) -> tuple[float, float, str]:
        cams = [(w[i][7 + 3 * k], -k) for k in (0, 1) if w[i][5 + 3 * k] is not None and w[i][7 + 3 * k] is not None]
        if cams:
            k = -max(cams)[1]
            return w[i][5 + 3 * k], w[i][6 + 3 * k], ("cam66", "cam68")[k]
        near = [(w[j][5 + 3 * k], w[j][6 + 3 * k]) for j in range(max(0, i - 2), min(len(w), i + 3)) if j != i for k in (0, 1) if w[j][5 + 3 * k] is not None]
        if near:
            return sum(p[0] for p in near) / len(near), sum(p[1] for p in near) / len(near), "interpolated"
        return w[i][2], w[i][3], "3d"

    def judged(state: dict, seen: float) -> list[tuple]:
        w = state["w"]
        n = len(w)
        if n < max(least, 2 * m + 1):
            return []
        start = n - 1
        while start > 0 and w[start][1] - w[start - 1][1] <= pause:
            start -= 1
        i = n - 1 - m
        if n - start < least or i < start + m:
            return []
        t, x, y, z = w[i][1:5]
        if z > z_max or abs(x) > COURT.half_width + 1 or abs(y) > COURT.half_length + 1 or t - state["last"] < cooldown:
            return []
        if sum(j >= start for j in range(max(0, i - dense_reach), min(n, i + dense_reach + 1))) < dense:
            return []
        a, b = w[max(start, i - span)], w[min(n - 1, i + span)]
        if b[1] - a[1] > 1e-6 and sum((b[k] - a[k]) ** 2 for k in (2, 3, 4)) ** 0.5 / (b[1] - a[1]) < min_speed:
            return []
        zs, ts = [r[4] for r in w], [r[1] for r in w]
        before, after = sum(zs[i - v_rows : i]) / v_rows - z, sum(zs[i + 1 : i + v_rows + 1]) / v_rows - z
        low, high = min(before, after), max(before, after)
        if not (low >= 0.05 and high >= 0.10):
            return []
        ratio = 0.0
        for h in halves:
            l, r, j = slice(max(start, i - h), i + 1), slice(i, min(n, i + h + 1)), slice(max(start, i - h), min(n, i + h + 1))
            nl, nr = len(zs[l]), len(zs[r])
            split = (_rest(ts[l], zs[l]) * nl + _rest(ts[r], zs[r]) * nr) / (nl + nr)
            ratio = max(ratio, _rest(ts[j], zs[j]) / split if split > 1e-8 else 0.0)
        if not (low >= 0.10 and high >= 0.20 or ratio >= 5.0 or ratio >= 2.0 and z < 0.4):
            return []
        state["last"] = t
        at = min(range(max(start, i - 4), min(n - 1, i + 4) + 1), key=lambda j: (zs[j], j))
        px, py, source = place(w, at)
        inside = abs(px) <= COURT.half_width and abs(py) <= COURT.half_length
        return [(1, "landing", seen, int(w[at][0]), w[at][1], px, py, w[at][4], None, None, inside, round(min(1.0, before + after + 0.1 * ratio), 3), source)]

    def step(state: dict, row) -> list[tuple]:
        if row.kind == "crossing":
            return [(0, "crossing", float(row.seen), int(row.frame), float(row.t), float(row.x), float(row.y), float(row.z), int(row.speed), row.direction, None, None, None)]
        if row.kind != "point":
            return []
        cams = [None if _none(getattr(row, c)) else float(getattr(row, c)) for c in _CAMS]
        state["w"] = [*state["w"], [int(row.frame), float(row.t), float(row.x), float(row.y), float(row.z), *cams]][-size:]
        return judged(state, float(row.seen))

    return Rule(schema, {"w": [], "last": 0.0}, step, ties=("seq",))


# ---- which landings count --------------------------------------------------------------------

def acceptance(match_s: float = 3.0, dup_s: float = 0.7, dup_m: float = 1.0, min_s: float = 0.4, min_m: float = 2.0, context_s: float | None = None) -> Rule:
    """A verdict for each landing: it takes the latest unused crossing of the last seconds, and gives it back if it is rejected.

    Rejected are repeats of the last five accepted ones (near in time and place), second reports on one side right
    after an accepted one, and, with ``context_s``, landings without a crossing that recent. Crossings pass.
    """
    schema = "kind string, frame long, t double, x double, y double, z double, speed long, direction string, in_court boolean, confidence double, source string, verdict string"

    def step(state: dict, row) -> list[tuple]:
        if row.kind not in ("crossing", "landing"):
            return []
        if row.kind == "crossing":
            state["c"] = [c for c in state["c"] if float(row.t) - c[0] < 2 * match_s][-100:] + [[float(row.t), int(row.speed), row.direction, False]]
            return [("crossing", int(row.frame), float(row.t), float(row.x), float(row.y), float(row.z), int(row.speed), row.direction, None, None, None, None)]
        return judge(state, row)

    def judge(state: dict, row) -> list[tuple]:
        t, x, y = (round(float(v), 4) for v in (row.t, row.x, row.y))
        half = "near" if y < COURT.net_y else "far"
        dist = lambda p: ((x - p[1]) ** 2 + (y - p[2]) ** 2) ** 0.5
        seen = float(row.seen)
        taken = next((c for c in reversed(state["c"]) if not c[3] and seen - c[0] < match_s), None)
        verdict, accepted = "accepted", state["a"]
        for p in reversed(accepted[-5:]):
            if t - p[0] > dup_s:
                break
            if t >= p[0] and dist(p) < dup_m:
                verdict = "duplicate"
                break
        if verdict == "accepted" and accepted and 0 <= t - accepted[-1][0] < min_s and accepted[-1][3] == half and dist(accepted[-1]) < min_m:
            verdict = "f2_min_interval"
        if verdict == "accepted" and context_s is not None:
            if not state["c"]:
                verdict = "f4_no_net_crossing"
            elif t - state["c"][-1][0] > context_s:
                verdict = "f4_stale_net_crossing"
        speed = direction = None
        if taken is not None:
            speed, direction = taken[1], taken[2]
            taken[3] = verdict == "accepted"
        if verdict == "accepted":
            state["a"] = [*accepted, [t, x, y, half]][-5:]
        return [("landing", int(row.frame), t, x, y, float(row.z), speed, direction, bool(row.in_court), float(row.confidence), row.source, verdict)]

    return Rule(schema, {"c": [], "a": []}, step, ties=("seq",))


# ---- rallies by crossings --------------------------------------------------------------------

def crossing_rallies(timeout: float = 3.0) -> Rule:
    """A rally opens with a net crossing and closes when no point came for ``timeout`` seconds, by the next point or by timer."""
    schema = "rally long, start_frame long, end_frame long, start_t double, end_t double, strokes long, bounces long"

    def close(state: dict) -> list[tuple]:
        g, state["g"] = state["g"], None
        return [(state["n"], g["f"], state["f"], g["t"], state["t"], g["k"], g["b"])]

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        f, t, y, out = int(row.frame), float(row.t), float(row.y), []
        if state["g"] and t - state["t"] > timeout:
            out += close(state)
        was, state["y"] = state["y"], y
        if was is not None and (was < COURT.net_y <= y or was >= COURT.net_y > y):
            if state["g"] is None:
                state["n"] += 1
                state["g"] = {"f": f, "t": t, "k": 0, "b": 0}
            state["g"]["k"] += 1
        state["f"], state["t"] = f, t
        if state["g"] and row.bounce:
            state["g"]["b"] += 1
        return out

    return Rule(schema, {"n": 0, "g": None, "f": None, "t": None, "y": None}, step, lambda s: s["t"] + timeout if s["g"] else None, close)


# ---- both cameras, one or none ---------------------------------------------------------------

def _dip(w: list, z_max: float, noise: float = 0.15, dip: float = 0.1) -> int | None:
    """Place of the lowest row after two falling and before one rising step, if it is near the ground and below both ends."""
    z = [r[3] for r in w]
    ok = [k for k in range(2, len(z) - 1) if z[k - 2] >= z[k - 1] - noise and z[k - 1] >= z[k] - noise and z[k] <= z[k + 1] + noise]
    if not ok:
        return None
    k = min(ok, key=lambda i: (z[i], i))
    return None if z[k] > z_max or z[k] > min(z[k - 2], z[k + 1]) - dip else k


def fusion(max_ray: float = 2.0, keep: int = 20, reset: int = 10, cooldown: int = 8, prominence: float = 15.0, distance: int = 5, size: int = 8,
           z_max: float = 0.25, dip_cooldown: int = 5, jump: float = 150.0, tail_gap: int = 3, sure: float = 0.6) -> Rule:
    """Typed rows of each frame of two cameras: its mode and point, landings while a point is played, and points played.

    Both cameras near one another in space: 3-D mode, dips of the height. Otherwise the surer (or only) camera on the
    ground plane: peaks of the image row, once a point is on. Coming from one camera the 3-D window starts anew, a gap
    over ``reset`` frames clears all windows, and image peaks keep a distance from any landing before.
    """
    schema = ("kind string, frame long, mode string, camera string, x double, y double, z double, confidence double, "
              "start_frame long, strokes long, bounces long, reason string")
    init = {"a": [], "b": [], "w": [], "seen": None, "last": -100, "mode": None, "f": None, "r": R.point_state()}

    def image_peak(state: dict, side: str, f: int) -> list | None:
        if f - state["last"] < cooldown:
            return None
        w = state[side]
        cut = next((i for i in range(len(w) - 1, 0, -1) if w[i][0] - w[i - 1][0] > tail_gap), 0)
        w = w[cut:]
        if len(w) < 7:
            return None
        hits = [i for i in peak_positions([p[1] for p in w], distance, prominence) if i <= len(w) - 2 and w[i][0] - state["last"] >= cooldown]
        return w[max(hits)] if hits else None

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        f, out = int(row.frame), []
        if state["f"] is not None and f - state["f"] > reset:
            state.update(a=[], b=[], w=[], seen=None)
        cams = {s: None if _none(getattr(row, f"{s}_x")) else [float(getattr(row, f"{s}_{c}")) for c in ("x", "y", "py", "conf")] for s in "ab"}
        for s, c in cams.items():
            w = state[s]
            if c and not (w and abs(c[2] - w[-1][1]) > jump * max(1, f - w[-1][0])):
                state[s] = [*w, [f, c[2], c[0], c[1]]][-keep:]
        playing, hit = state["r"]["mode"], None
        a, b = cams["a"], cams["b"]
        ray = float(row.ray_dist) if not _none(row.ray_dist) else float("inf")
        if a and b and ray < max_ray:
            mode, camera, point = "3d", None, [float(row.x), float(row.y), float(row.z)]
            if state["mode"] == "single_cam":
                state.update(w=[], seen=None)
            best = "a" if a[3] >= b[3] else "b"
            state["w"] = [*state["w"], [f, *point, *cams[best][:2], best]][-size:]
            if not (state["seen"] is not None and f - state["seen"] < dip_cooldown) and len(state["w"]) >= 4:
                w = state["w"]
                k = _dip(w, z_max)
                if k is not None:
                    z = [r[3] for r in w]
                    depth = min(1.0, min(z[max(0, k - 2)], z[min(len(z) - 1, k + 2)]) - z[k])
                    hit = (w[k][0], w[k][4], w[k][5], z[k], round(min(1.0, 0.7 * depth + 0.3 * min(1.0, len(z) / 6.0)), 3), {"a": "cam66", "b": "cam68"}[w[k][6]])
                    state.update(seen=f, w=w[k + 1:])
        else:
            side = "a" if a and (not b or a[3] >= b[3]) else "b"
            mode, camera, ray = "single_cam", {"a": "cam66", "b": "cam68"}[side], float("inf")
            point = [*cams[side][:2], 0.0]
            if playing != "idle" and (p := image_peak(state, side, f)):
                hit = (p[0], p[2], p[3], 0.0, sure, camera)
        out.append(("mode", f, mode, camera, *point, *[None] * 5))
        if hit:
            state["last"] = hit[0]
            if playing in ("rally", "serving"):
                out.append(("landing", hit[0], mode, hit[5], *hit[1:4], hit[4], *[None] * 4))
        state.update(mode=mode, f=f)
        inside = hit and abs(hit[1]) <= COURT.half_width and abs(hit[2]) <= COURT.half_length
        fed = _Fed(f, f / FPS, point[1], point[2], ray, hit[1] if hit else None, hit[2] if hit else None, bool(inside) if hit else None)
        for g in R.point_step(state["r"], fed):
            out.append(("rally", g[1], mode, None, *[None] * 4, g[0], g[4], g[5], g[6]))
        return out

    def clear(state: dict) -> list[tuple]:
        state.update(a=[], b=[], w=[], seen=None)
        return []

    return Rule(schema, init, step, lambda s: (s["f"] + reset) / FPS if s["a"] or s["b"] or s["w"] else None, clear)


class _Fed:
    def __init__(self, frame, t, y, z, ray_dist, b_x, b_y, b_in):
        self.frame, self.t, self.y, self.z, self.ray_dist, self.b_x, self.b_y, self.b_in = frame, t, y, z, ray_dist, b_x, b_y, b_in
