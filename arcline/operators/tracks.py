"""Linking blobs into tracks, matching tracks of two cameras, and best paths over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import triangulated
from ..session import cut_lineage
from .fold import fold
from .ordered import segments
from .stats import quantiles

KEYS = ["session_id"]


def link_frame(live: list[dict], f: int, blobs: list[tuple[float, float]], max_px: float, gap: int) -> tuple[list[dict], list[tuple]]:
    """Tracks after frame ``f`` and (blob, x, y, track) of each blob: live tracks, longer ones first, take the blob nearest to their guess."""
    live = sorted((t for t in live if f - t["p"][-1][0] <= gap), key=lambda t: -t["n"])
    free, out = dict(enumerate(blobs)), []
    for t in live:
        a = t["p"][-1]
        gx, gy = a[1], a[2]
        if len(t["p"]) == 2:
            o = t["p"][0]
            k = (f - a[0]) / (a[0] - o[0])
            gx, gy = gx + k * (a[1] - o[1]), gy + k * (a[2] - o[2])
        near = min(free, key=lambda i: ((free[i][0] - gx) ** 2 + (free[i][1] - gy) ** 2, i), default=None)
        if near is not None and ((free[near][0] - gx) ** 2 + (free[near][1] - gy) ** 2) ** 0.5 < max_px:
            x, y = free.pop(near)
            t["p"], t["n"] = [a, [f, x, y]], t["n"] + 1
            out.append((near, x, y, t["id"]))
    for i, (x, y) in free.items():
        live.append({"id": f"{f}-{i}", "n": 1, "p": [[f, x, y]]})
        out.append((i, x, y, f"{f}-{i}"))
    return live, out


def link_blobs(cands: DataFrame, max_px: float = 80.0, gap: int = 3, min_rows: int = 10) -> DataFrame:
    """Greedy nearest linking with a velocity guess; longer live tracks choose first.

    A track is named by its first frame and blob, so names do not depend on other chunks.
    """
    keys = ["session_id", "camera"]
    rows = cands.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("rank", "pixel_x", "pixel_y"))).alias("blobs"))

    def step(state, row):
        f = int(row.frame)
        state["live"], out = link_frame(state["live"], f, [(float(b["pixel_x"]), float(b["pixel_y"])) for b in row.blobs], max_px, gap)
        return [(f, x, y, track) for _, x, y, track in out]

    t = fold(rows, keys, "frame", {"live": []}, step, "frame long, pixel_x double, pixel_y double, track string")
    long = t.groupBy(*keys, "track").agg(F.count("*").alias("length")).where(F.col("length") >= min_rows)
    return t.join(long, [*keys, "track"])


def match_tracks(a: DataFrame, b: DataFrame, cam_a: tuple, cam_b: tuple, min_common: int = 10, max_ray: float = 1.0, top: int | None = None) -> DataFrame:
    """Track pairs of two cameras that see one object; rows are the triangulated common frames.

    All tracks take part; ``top`` leaves only each camera's longest ones of a session. ``a`` and ``b``
    hold session, track, frame, length, world_x, world_y.
    """
    def longest(d: DataFrame, n: str) -> DataFrame:
        w = Window.partitionBy("session_id").orderBy(F.desc("length"), "track")
        if top is not None:
            keep = d.select("session_id", "track", "length").distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
            d = d.join(keep.select("session_id", "track"), ["session_id", "track"], "left_semi")
        return d.select("session_id", "frame", F.col("track").alias(f"track_{n}"), F.col("world_x").alias(f"{n}_x"), F.col("world_y").alias(f"{n}_y"))

    t = triangulated(longest(a, "a").join(longest(b, "b"), ["session_id", "frame"]), "a", "b", cam_a, cam_b)
    pair = ["session_id", "track_a", "track_b"]
    s = t.groupBy(*pair).agg(F.count("*").alias("overlap"), F.avg(F.col("z").between(0.05, 5.0).cast("double")).alias("z_ok"))
    s = s.where((F.col("overlap") >= min_common) & (F.col("z_ok") > 0.5))
    med = quantiles(t.join(s.select(*pair), pair, "left_semi"), pair, "ray_dist", {"median_ray": 0.5}, step=0.001)
    s = s.join(med, pair).where(F.col("median_ray") < max_ray)
    return t.join(s, pair)


def merge_tracks(matched: DataFrame) -> DataFrame:
    """One point per frame; the pair with the longest overlap wins."""
    best = F.max_by(F.struct("x", "y", "z", "ray_dist", "overlap"), F.struct("overlap", F.col("track_a"), F.col("track_b")))
    return matched.groupBy("session_id", "frame").agg(best.alias("p")).select("session_id", "frame", "p.*")


def best_paths(pairs: DataFrame, gap: int = 5, min_frames: int = 3, fps: float = 25.0) -> DataFrame:
    """Cheapest candidate sequence per gap-free stretch.

    Emission costs are columns. A forward fold keeps the cost and best predecessor of every
    candidate; a backward fold over the same rows follows the predecessors from each stretch's
    cheapest end. Costs are kept relative to the frame's best, so the state stays small.
    """
    from ..court import COURT

    off = (F.abs("x") > COURT.half_width + 3) | (F.abs("y") > COURT.half_length + 3)
    c = pairs.withColumn("emit", 2 * F.col("ray_dist") + F.when(off, 3.0).otherwise(0.0))
    c = c.groupBy(*KEYS, "frame").agg(F.array_sort(F.collect_list(F.struct("a_rank", "b_rank", "x", "y", "z", "emit", "ray_dist"))).alias("cands"))
    # stretches are found on frame numbers alone, and the candidates are made once for both folds and the answer
    seg = segments(cut_lineage(c.select(*KEYS, "frame")), KEYS, "frame", gap)
    size = seg.groupBy(*KEYS, "seg").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_frames).select(*KEYS, "seg")
    c = cut_lineage(c.join(seg.join(size, [*KEYS, "seg"], "left_semi"), [*KEYS, "frame"]))

    def move(p, q, dt, before, dt_before):
        d = [q[i] - p[i] for i in range(3)]
        v = sum(u * u for u in d) ** 0.5 / dt
        if v > 90:
            return 999.0
        cost = 5.0 if v < 1.5 else 2.0 if v <= 5 else 0.0 if v < 70 else 1.0
        if before is not None:
            back = sum((q[i] - before[i]) ** 2 for i in range(3)) ** 0.5
            leg = sum((p[i] - before[i]) ** 2 for i in range(3)) ** 0.5
            if leg > 0.5 and back < leg / 2:
                cost += 10.0
            was, now = (p[1] - before[1]) / dt_before, d[1] / dt
            if abs(was) > 3 and abs(now) > 3 and was * now < 0:
                cost += 5.0
        return cost - 8.0 if p[1] * q[1] < 0 and v > 8 else cost

    def forward(state, row):
        f, seg = int(row.frame), int(row.seg)
        cur = [[float(k["x"]), float(k["y"]), float(k["z"])] for k in row.cands]
        emit = [float(k["emit"]) for k in row.cands]
        if state["seg"] != seg:
            total, came, hist = emit, [None] * len(cur), None
        else:
            dt = (f - state["f"]) / fps
            total, came = [], []
            for q, e in zip(cur, emit):
                opts = []
                for j, p in enumerate(state["pos"]):
                    o = state["came"][j]
                    before = state["old"][o] if state["old"] is not None and o is not None else None
                    opts.append((state["cost"][j] + move(p, q, dt, before, state["dt"]), j))
                best = min(opts)
                total.append(best[0] + e)
                came.append(best[1])
            hist = state["pos"]
            state["dt"] = dt
        low = min(total)
        state.update(seg=seg, f=f, pos=cur, old=hist, came=came, cost=[t - low for t in total])
        return [(f, seg, [[-1 if j is None else j for j in came], [total.index(low)]])]

    steps = fold(c.select(*KEYS, "frame", "seg", "cands"), KEYS, "frame",
                 {"seg": None, "f": None, "pos": None, "old": None, "came": None, "cost": None, "dt": None}, forward,
                 "frame long, seg long, links array<array<long>>")

    def backward(state, row):
        seg = int(row.seg)
        k = int(row.links[1][0]) if state["seg"] != seg else state["k"]
        state["seg"], state["k"] = seg, int(row.links[0][k])
        return [(-int(row.back), k)]

    rev = steps.withColumn("back", -F.col("frame"))
    chosen = fold(rev.select(*KEYS, "back", "seg", "links"), KEYS, "back", {"seg": None, "k": None}, backward, "frame long, k long")
    j = chosen.join(c.select(*KEYS, "frame", "seg", "cands"), [*KEYS, "frame"]).withColumn("c", F.get("cands", F.col("k").cast("int")))
    return j.select(*KEYS, "frame", "seg", "c.*")
