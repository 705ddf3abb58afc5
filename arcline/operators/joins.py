"""Time and frame joins: band, as-of, interpolating, one-to-one nearest, interval.

No join here is keyed by the session alone: band joins add a bucket of the order column, as-of
joins are two-level window scans, and one-to-one matching is a chunked fold, so one very long
session spreads over all tasks. Nothing is broadcast by hint; Spark does so where its own size
estimate allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hypot, triangulated
from . import ordered
from .fold import fold
from .ordered import neighbour


def last_per_frame(df: DataFrame, keys: Sequence[str], by: str = "event_id") -> DataFrame:
    """One row per frame; the latest write wins."""
    part = [*keys, "frame"]
    rest = [c for c in df.columns if c not in part]
    return df.groupBy(*part).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*part, "_r.*")


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], lcol: str, rcol: str,
    before: float, after: float, how: str = "inner",
) -> DataFrame:
    """Join rows whose ``rcol`` lies within [lcol - before, lcol + after].

    Left rows are copied to the one to three buckets their band touches, right rows stay in
    theirs: an equi-join with a residual predicate. ``how``: inner, left_semi or left_anti.
    """
    width = max(before + after, 1)
    l, r = F.col(lcol), F.col(rcol)
    lo, hi = F.floor((l - before) / width).cast("long"), F.floor((l + after) / width).cast("long")
    lb = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    rb = right.withColumn("_bucket", F.floor(r / width).cast("long"))
    on = [*keys, "_bucket"]
    if how == "inner":
        return lb.join(rb, on).where(r.between(l - before, l + after)).drop("_bucket")
    near = rb.select(*on, r.alias("_r"))
    hit = lb.join(near, [lb[k] == near[k] for k in on] + [near["_r"].between(lb[lcol] - before, lb[lcol] + after)], "left_semi")
    hit = hit.select(*keys, lcol).distinct()
    return left.join(hit, [*keys, lcol], how)


def interval_join(rows: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Rows inside closed intervals; overlapping intervals repeat the row."""
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    t = rows.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    return t.join(s, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str,
    backward: dict[str, Column] | None = None, forward: dict[str, Column] | None = None,
    inclusive: bool = True,
    unit: int = 1,
) -> DataFrame:
    """Nearest right row at or before (``backward``) and / or at or after (``forward``).

    ``{output name: expression over the right side}``. ``on`` must be integral on both sides, in
    ``unit`` steps per frame, so that blocks keep their number of rows.
    """
    block = 2 * unit * ordered.BLOCK
    backward, forward = backward or {}, forward or {}
    exprs = backward | forward
    r = right.select(*keys, on, F.struct(*[c.alias(n) for n, c in exprs.items()]).alias("_v"), F.lit(0).alias("_side"))
    l = left.withColumn("_side", F.lit(1))
    u = l.unionByName(r, allowMissingColumns=True)
    o = F.col(on)
    is_right = F.col("_side") == 0
    out = u
    if backward:
        tie = F.when(is_right, 0).otherwise(1) if inclusive else F.when(is_right, 1).otherwise(0)
        out = neighbour(out.withColumn("_o", 2 * o + tie), keys, "_o", prev={"_b": (is_right, F.col("_v"))}, block=block)
    if forward:
        tie = F.when(is_right, 1).otherwise(0) if inclusive else F.when(is_right, 0).otherwise(1)
        out = neighbour(out.withColumn("_o", 2 * o + tie), keys, "_o", next={"_f": (is_right, F.col("_v"))}, block=block)
    cols = [F.col("_b")[n].alias(n) for n in backward] + [F.col("_f")[n].alias(n) for n in forward]
    return out.where("_side = 1").select(*left.columns, *cols)


def interpolate_at(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, pos: Sequence[str], scale: int = 1,
                   out: str = "i_") -> DataFrame:
    """Position of ``right`` at each left time by linear blend of its two surrounding rows.

    ``at`` and right's ``frame`` are compared on a grid of ``1 / scale`` frames.
    """
    names = ["frame", *pos]
    r = right.select(*keys, *names).withColumn("_q", (F.col("frame") * scale).cast("long"))
    l = left.withColumn("_q", F.round(F.col(at) * scale).cast("long"))
    j = asof(l, r, keys, "_q", {f"_p_{c}": F.col(c) for c in names}, {f"_n_{c}": F.col(c) for c in names}, unit=scale)
    f0, f1 = F.col("_p_frame"), F.col("_n_frame")
    w = F.when(f1 == f0, 0.0).otherwise((F.col(at) - f0) / (f1 - f0))
    j = j.where(f0.isNotNull() & f1.isNotNull())
    blended = {f"{out}{c}": F.col(f"_p_{c}") + w * (F.col(f"_n_{c}") - F.col(f"_p_{c}")) for c in pos}
    return j.withColumns(blended).drop("_q", *[f"_{s}_{c}" for s in "pn" for c in names])


def match_one_to_one(
    driver: DataFrame, partner: DataFrame, keys: Sequence[str], on: str, tolerance: int,
    policy: str = "nearest_unused", strict: bool = False, unit: int = 1,
) -> DataFrame:
    """Greedy matching in driver order; each partner row is used once.

    Policies: ``nearest_unused`` picks the nearest free partner, ``nearest_then_check`` rejects
    when the nearest is taken, ``first_within`` takes the earliest free one. Both sides pass once
    through a fold whose state is the rows within the tolerance. ``on`` values are unique per side.
    ``unit`` is the number of ``on`` steps per frame. Returns driver time and the partner's (null
    when unmatched).
    """
    limit = tolerance - 1 if strict else tolerance

    def settle(state, upto):
        out = []
        while state["wait"] and (upto is None or state["wait"][0] + limit < upto):
            t = state["wait"].pop(0)
            near = [p for p in state["pool"] if abs(p[0] - t) <= limit]
            if policy == "nearest_unused":
                near = sorted((p for p in near if not p[1]), key=lambda p: (abs(p[0] - t), p[0]))
            elif policy == "nearest_then_check":
                near = [p for p in sorted(near, key=lambda p: (abs(p[0] - t), p[0]))[:1] if not p[1]]
            else:
                near = [p for p in near if not p[1]]
            if near:
                near[0][1] = 1
            out.append((t, near[0][0] if near else None))
        low = (state["wait"][0] if state["wait"] else upto if upto is not None else 0) - limit
        state["pool"] = [p for p in state["pool"] if p[0] >= low]
        return out

    def step(state, row):
        out = settle(state, row.at)
        if row.side:
            state["wait"].append(int(row.at))
        else:
            state["pool"].append([int(row.at), 0])
        return out

    d = driver.select(*keys, F.col(on).cast("long").alias("at"), F.lit(1).alias("side"))
    p = partner.select(*keys, F.col(on).cast("long").alias("at"), F.lit(0).alias("side"))
    return fold(d.unionByName(p), keys, "at", {"wait": [], "pool": []}, step, "driver_at long, partner_at long",
                flush=lambda s: settle(s, None), block=unit * ordered.BLOCK)


# ---- joins of two cameras -------------------------------------------------------------------

def pair_frames(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """Equi-join of two cameras on frame (camera b read at ``frame + shift``)."""
    left = a.select("session_id", "frame", *[F.col(c).alias(f"a_{n}") for c, n in _CAM])
    right = b.select("session_id", (F.col("frame") - shift).alias("frame"), *[F.col(c).alias(f"b_{n}") for c, n in _CAM])
    return left.join(right, ["session_id", "frame"])


_CAM = [("world_x", "x"), ("world_y", "y"), ("pixel_x", "px"), ("pixel_y", "py"), ("blob_sum", "conf")]


def candidate_pairs(cands_a: DataFrame, cands_b: DataFrame, cam_a: tuple, cam_b: tuple,
                    max_ray: float = 2.0, z: tuple[float, float] = (0.0, 8.0)) -> DataFrame:
    """Every candidate of camera a with every one of b in the same frame, triangulated and gated.

    A frame holds a handful of ranked candidates per camera by construction. The gate runs over the frame's list of
    points: as a filter it would be pushed below the triangulation and compute all of it anew for each reference.
    """
    cols = [("rank", "rank"), *_CAM]
    keys = ["session_id", "frame"]
    a = cands_a.select("session_id", "frame", *[F.col(c).alias(f"a_{n}") for c, n in cols])
    b = cands_b.select("session_id", "frame", *[F.col(c).alias(f"b_{n}") for c, n in cols])
    t = triangulated(a.join(b, keys), "a", "b", cam_a, cam_b)
    rest = [c for c in t.columns if c not in keys]
    t = t.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_p"))
    near = F.filter("_p", lambda p: (p["ray_dist"] <= max_ray) & p["z"].between(*z))
    return t.select(*keys, F.explode(near).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def best_pairs(pairs: DataFrame, rank_penalty: float = 0.5) -> DataFrame:
    """Lowest ray distance plus rank penalty per frame, no memory between frames."""
    score = F.col("ray_dist") + rank_penalty * (F.col("a_rank") + F.col("b_rank"))
    pick = F.struct("x", "y", "z", "ray_dist", "a_rank", "b_rank")
    return pairs.groupBy("session_id", "frame").agg(
        F.min_by(pick, F.struct(score.alias("s"), F.col("a_rank"), F.col("b_rank"))).alias("p")).select("session_id", "frame", "p.*")


def track_pairs(pairs: DataFrame, rank_penalty: float = 0.5, temporal: float = 0.3, lost: int = 10,
                max_speed: float = 80.0, fps: float = 25.0) -> DataFrame:
    """As ``best_pairs`` plus a pull towards the position predicted from the last two picks."""
    c = F.struct("a_rank", "b_rank", "x", "y", "z", "ray_dist")
    frames = pairs.groupBy("session_id", "frame").agg(F.array_sort(F.collect_list(c)).alias("cands"))

    def step(state, row):
        p, v, last = state["p"], state["v"], state["f"]
        f = int(row.frame)
        guess = None
        if p is not None and f - last <= lost:
            k = (f - last) / fps
            guess = p if v is None else [p[i] + v[i] * k for i in range(3)]
        cost = []
        for c in row.cands:
            pos = [c["x"], c["y"], c["z"]]
            s = c["ray_dist"] + rank_penalty * (c["a_rank"] + c["b_rank"])
            if guess is not None:
                s += temporal * sum((m - n) ** 2 for m, n in zip(pos, guess)) ** 0.5
            cost.append((s, int(c["a_rank"]), int(c["b_rank"]), pos, c["ray_dist"]))
        s, ra, rb, pos, ray = min(cost, key=lambda q: q[:3])
        plain = min(cost, key=lambda q: (q[4], q[1], q[2]))
        if p is not None and f > last:
            vel = [(m - n) / ((f - last) / fps) for m, n in zip(pos, p)]
            if sum(u * u for u in vel) ** 0.5 <= max_speed:
                state["v"] = vel
        state["p"], state["f"] = [float(u) for u in pos], f
        return [(f, *pos, ray, ra, rb, guess is not None, (ra, rb) != plain[1:3])]

    return fold(frames, ["session_id"], "frame", {"p": None, "v": None, "f": -1}, step,
                "frame long, x double, y double, z double, ray_dist double, a_rank long, b_rank long, tracking boolean, assisted boolean")


def fuse_detectors(a: DataFrame, b: DataFrame, keys: Sequence[str], agree: float = 3.0, px_per_m: float = 80.0,
                   boost: float = 1.2, penalty: float = 0.7, single: float = 0.8) -> DataFrame:
    """Two detectors per frame: weighted mean where they agree, the surer one where not."""
    cols = ["pixel_x", "pixel_y", "conf"]
    l = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    r = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = l.join(r, list(keys), "full_outer")
    ca, cb = F.col("a_conf"), F.col("b_conf")
    only_a, only_b = cb.isNull(), ca.isNull()
    close = hypot(F.col("a_pixel_x") - F.col("b_pixel_x"), F.col("a_pixel_y") - F.col("b_pixel_y")) < agree * px_per_m
    wa = F.when(ca + cb > 0, ca / (ca + cb)).otherwise(0.5)
    wb = F.when(ca + cb > 0, cb / (ca + cb)).otherwise(0.5)

    def pick(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.when(only_a, x).when(only_b, y).when(close, x * wa + y * wb).otherwise(F.when(ca >= cb, x).otherwise(y))

    conf = (F.when(only_a, ca * single).when(only_b, cb * single).when(close, F.greatest(ca, cb) * boost)
            .otherwise(F.greatest(ca, cb) * penalty))
    source = F.when(only_a, "a_only").when(only_b, "b_only").when(close, "agree").otherwise("disagree")
    return j.select(*keys, pick("pixel_x").alias("pixel_x"), pick("pixel_y").alias("pixel_y"), conf.alias("conf"), source.alias("source"))


def fusion_mode(a: DataFrame, b: DataFrame, cam_a: tuple, cam_b: tuple, max_ray: float = 2.0) -> DataFrame:
    """Per frame: 3-D point when both cameras agree, else the surer camera on the ground plane."""
    l = a.select("session_id", "frame", *[F.col(c).alias(f"a_{n}") for c, n in _CAM])
    r = b.select("session_id", "frame", *[F.col(c).alias(f"b_{n}") for c, n in _CAM])
    t = triangulated(l.join(r, ["session_id", "frame"], "full_outer"), "a", "b", cam_a, cam_b)
    both = F.col("a_x").isNotNull() & F.col("b_x").isNotNull()
    three = both & (F.col("ray_dist") < max_ray)
    use_a = F.when(both, F.col("a_conf") >= F.col("b_conf")).otherwise(F.col("a_x").isNotNull())
    return t.select(
        "session_id", "frame", F.when(three, "3d").otherwise("single_cam").alias("mode"),
        F.when(three, F.col("x")).when(use_a, F.col("a_x")).otherwise(F.col("b_x")).alias("x"),
        F.when(three, F.col("y")).when(use_a, F.col("a_y")).otherwise(F.col("b_y")).alias("y"),
        F.when(three, F.col("z")).otherwise(0.0).alias("z"),
        F.when(three, F.col("ray_dist")).otherwise(F.lit(float("inf"))).alias("ray_dist"),
        F.when(three, F.lit(None).cast("string")).when(use_a, "cam66").otherwise("cam68").alias("camera"))


def validate_across(det: DataFrame, other: DataFrame, max_dist: float = 5.0) -> DataFrame:
    """Drop rows whose counterpart of the other camera lies too far away; keep lone ones."""
    o = other.select("session_id", "frame", F.col("world_x").alias("_ox"), F.col("world_y").alias("_oy"))
    far = hypot(F.col("world_x") - F.col("_ox"), F.col("world_y") - F.col("_oy")) > max_dist
    return det.join(o, ["session_id", "frame"], "left").where(F.coalesce(~far, F.lit(True))).drop("_ox", "_oy")


def rescue_across(det: DataFrame, other_px: DataFrame, max_px: float = 100.0, near: int = 5, look: int = 10,
                  trust_gap: int = 3, trust_dist: float = 3.0, size: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """Fill frames missing in ``det`` from the other camera.

    ``other_px`` has the other camera's rows with its ground point already projected to this
    camera's pixels. Near an own row the fill must be consistent with it; in longer gaps the
    other camera must agree with itself.
    """
    keys = ["session_id"]
    miss = other_px.join(det.select("session_id", "frame"), ["session_id", "frame"], "left_anti")
    miss = miss.where(F.col("pixel_x").between(0, size[0]) & F.col("pixel_y").between(0, size[1]))
    side = {"f": F.col("frame"), "x": F.col("pixel_x"), "y": F.col("pixel_y")}
    j = asof(miss, det, keys, "frame", {f"_p{n}": c for n, c in side.items()}, {f"_n{n}": c for n, c in side.items()})
    gp = F.coalesce(F.col("frame") - F.col("_pf"), F.lit(999))
    gn = F.coalesce(F.col("_nf") - F.col("frame"), F.lit(999))
    ok = lambda s, g: (g <= look) & (hypot(F.col("pixel_x") - F.col(f"_{s}x"), F.col("pixel_y") - F.col(f"_{s}y")) <= max_px * g)
    consistent = F.coalesce(ok("p", gp), F.lit(False)) | F.coalesce(ok("n", gn), F.lit(False))
    close = F.least(gp, gn) <= near
    peer = other_px.select("session_id", F.col("frame").alias("_of"), F.col("world_x").alias("_ox"), F.col("world_y").alias("_oy"))
    trusted = (
        band_join(j.where(~close), peer, keys, "frame", "_of", trust_gap, trust_gap)
        .where((F.col("_of") != F.col("frame")) & (hypot(F.col("world_x") - F.col("_ox"), F.col("world_y") - F.col("_oy")) < trust_dist))
        .select("session_id", "frame").distinct())
    cols = ["session_id", "frame", "pixel_x", "pixel_y"]
    by_own = j.where(close & consistent).select(*cols, F.lit("consistent").alias("origin"))
    by_peer = j.join(trusted, ["session_id", "frame"], "left_semi").select(*cols, F.lit("trusted").alias("origin"))
    own = det.select(*cols, F.lit("own").alias("origin"))
    return own.unionByName(by_own).unionByName(by_peer)


def trimmed_mean(df: DataFrame, by: Sequence[str], value: str, keep: float = 0.8) -> DataFrame:
    """Mean of the lowest ``keep`` share (at least one row) without sorting a group in one task.

    Values are counted in narrow bins first; only the bin holding the cut is ranked by value.
    """
    from pyspark.sql import Window

    by = list(by)
    binned = df.withColumn("_bin", F.floor(F.col(value) * 1000))
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_bin")
    allw = Window.partitionBy(*by)
    bins = bins.withColumns({
        "_to": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_k": F.greatest(F.lit(1), F.floor(F.sum("_n").over(allw) * keep))}).withColumn("_from", F.col("_to") - F.col("_n"))
    whole = bins.where(F.col("_to") <= F.col("_k")).groupBy(*by).agg(F.sum("_s").alias("_whole"))
    cut = bins.where((F.col("_from") < F.col("_k")) & (F.col("_to") > F.col("_k"))).select(*by, "_bin", (F.col("_k") - F.col("_from")).alias("_need"))
    inside = binned.join(cut, [*by, "_bin"]).groupBy(*by, "_need", F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    wv = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.sum("_c").over(wv))
    take = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_need") - F.col("_to") + F.col("_c")))
    part = inside.groupBy(*by).agg(F.sum(F.col("_v") * take).alias("_part"))
    total = bins.groupBy(*by).agg(F.max("_k").alias("_k"))
    return total.join(whole, by, "left").join(part, by, "left").select(
        *by, ((F.coalesce("_whole", F.lit(0.0)) + F.coalesce("_part", F.lit(0.0))) / F.col("_k")).alias("cost"))
