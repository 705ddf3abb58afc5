"""Track first, triangulate later, block by block, with memory of what is open only.

Blobs of each camera are linked into tracks as frames pass. Tracks of two cameras that share frames keep their
triangulated common frames while both are open. At the end of each block of frames the pair with the most common
frames, near in space and above the ground, is the ball: its points that no block has told yet come out, and so do
the landings among them. A pair whose track has ended is judged once more and forgotten but for its length, so a
block costs what is open in it, however long the session is.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence

from ..court import FPS
from ..operators.peaks import peak_positions
from ..operators.tracks import link_frame
from .inorder import Rule


def crossing_point(p: Sequence[float], q: Sequence[float], cam_a: Sequence[float], cam_b: Sequence[float]) -> tuple[list[float], float]:
    """Middle of the nearest points of the two lines of sight from the cameras to their ground positions, and their distance."""
    u, v = [p[0] - cam_a[0], p[1] - cam_a[1], -cam_a[2]], [q[0] - cam_b[0], q[1] - cam_b[1], -cam_b[2]]
    w = [a - b for a, b in zip(cam_a, cam_b)]
    dot = lambda m, n: sum(x * y for x, y in zip(m, n))
    clip = lambda x: min(max(x, 0.0), 1.0)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    if abs(det) < 1e-10:
        return [(p[0] + q[0]) / 2, (p[1] + q[1]) / 2, 0.0], float("inf")
    s = clip((uv * vw - vv * uw) / det)
    t = clip((vw + s * uv) / vv)
    s = clip((t * uv - uw) / uu)
    a, b = ([c + k * d for c, d in zip(cam, way)] for cam, k, way in ((cam_a, s, u), (cam_b, t, v)))
    return [(a[0] + b[0]) / 2, (a[1] + b[1]) / 2, max((a[2] + b[2]) / 2, 0.0)], sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5


def landings_of(points: list, z: tuple[float, float] = (0.02, 0.5), rows: int = 5, prominence: float = 0.10) -> list[list]:
    """Prominent dips of the height averaged over three points."""
    raw = [p[3] for p in points]
    n = len(raw)
    flat = [(raw[max(i - 1, 0)] + raw[i] + raw[min(i + 1, n - 1)]) / 3 for i in range(n)]
    return [[*points[i][:3], flat[i]] for i in peak_positions([-h for h in flat], rows, prominence) if z[0] < flat[i] <= z[1]]


def ball_of(pairs: dict, lengths: dict, min_rows: int, min_common: int, max_ray: float) -> list | None:
    """[-common frames, track of a, track of b] of the longest acceptable pair; of equal ones the first by name."""
    best = None
    for (a, b), pts in pairs.items():
        if len(pts) < min_common or min(lengths[a], lengths[b]) < min_rows:
            continue
        if statistics.median(p[4] for p in pts) < max_ray and 2 * sum(0.05 <= p[3] <= 5.0 for p in pts) > len(pts):
            key = [-len(pts), a, b]
            best = key if best is None or key < best else best
    return best


def block_tracks(cam_a: tuple, cam_b: tuple, block: int = 250, max_px: float = 80.0, gap: int = 3, min_rows: int = 10, min_common: int = 10, max_ray: float = 1.0) -> Rule:
    """Rows in: side, frame, rank, pixel and world position of each blob. Rows out: points of the ball and landings, once each."""
    init = {"f": None, "a": [], "b": [], "new": {"a": [], "b": []}, "pairs": {}, "n": {}, "best": None, "seen": [], "hits": [], "k": None}

    def frame_done(state: dict) -> None:
        f, spots = state["f"], {}
        for side in "ab":
            blobs = state["new"][side]
            if not blobs:
                continue
            state[side], got = link_frame(state[side], f, [(b[0], b[1]) for b in blobs], max_px, gap)
            spots[side] = [(f"{side}{track}", blobs[i][2:]) for i, _, _, track in got]
            for track, _ in spots[side]:
                state["n"][track] = state["n"].get(track, 0) + 1
        state["new"] = {"a": [], "b": []}
        for ta, p in spots.get("a", []):
            for tb, q in spots.get("b", []):
                point, ray = crossing_point(p, q, cam_a, cam_b)
                state["pairs"].setdefault(f"{ta} {tb}", []).append([f, *point, ray])

    def block_done(state: dict) -> list[tuple]:
        frame_done(state)
        pairs = {tuple(k.split(" ")): v for k, v in state["pairs"].items()}
        found, out = ball_of(pairs, state["n"], min_rows, min_common, max_ray), []
        if found and (state["best"] is None or found <= state["best"]):
            state["best"] = found
            points, seen, hits = pairs[found[1], found[2]], set(state["seen"]), set(state["hits"])
            fresh = [p for p in points if p[0] not in seen]
            lands = [h for h in landings_of(points) if h[0] not in hits]
            out = [("point", *p) for p in fresh] + [("landing", *h, None) for h in lands]
            state["seen"] += [p[0] for p in fresh]
            state["hits"] += [h[0] for h in lands]
        live = {side + t["id"] for side in "ab" for t in state[side] if state["f"] - t["p"][-1][0] <= gap}
        state["pairs"] = {f"{a} {b}": v for (a, b), v in pairs.items() if a in live and b in live}
        state["n"] = {t: n for t, n in state["n"].items() if t in live}
        first = min((v[0][0] for v in state["pairs"].values()), default=state["f"] + 1)
        state["seen"], state["hits"] = ([f for f in state[c] if f >= first] for c in ("seen", "hits"))
        state["k"] = None
        return out

    def step(state: dict, row) -> list[tuple]:
        if row.frame is None:
            return []
        f, out = int(row.frame), []
        if state["k"] is not None and f // block > state["k"]:
            out = block_done(state)
        elif state["k"] is not None and f != state["f"]:
            frame_done(state)
        state["f"], state["k"] = f, f // block
        state["new"][row.side].append([float(row.pixel_x), float(row.pixel_y), float(row.world_x), float(row.world_y)])
        return out

    return Rule("kind string, frame long, x double, y double, z double, ray_dist double", init, step,
                lambda s: (s["k"] + 1) * block / FPS if s["k"] is not None else None, block_done, ties=("frame", "side", "rank"))
