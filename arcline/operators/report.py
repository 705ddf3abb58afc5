"""Match reports, player statistics and export tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows per key. The rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def speed_bands(speeds: DataFrame, by: Sequence[str], speed: str = "speed_kmh") -> DataFrame:
    """Counts in the five named tiers and the thirteen 10 km/h bins from 20, empty ones kept."""
    s = F.col(speed)
    edges = [("Slow", None, 40), ("Medium", 40, 65), ("Fast", 65, 90), ("Power", 90, 115), ("Max", 115, None)]
    parts = []
    for name, lo, hi in edges:
        ok = (F.lit(True) if lo is None else s >= lo) & (F.lit(True) if hi is None else s < hi)
        parts.append(("tier", name, F.count_if(ok)))
    bin_no = F.least(F.floor((s - 20) / 10), F.lit(12))
    parts += [("bin", f"{20 + 10 * i}-{30 + 10 * i}", F.count_if(bin_no == i)) for i in range(13)]
    agg = speeds.groupBy(*by).agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(parts)])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("label"), F.col(f"_{i}").alias("n")) for i, (k, n, _) in enumerate(parts)])
    return agg.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def match_summary(points: DataFrame, rally_rows: DataFrame, speeds: DataFrame, shots: DataFrame, landings: DataFrame) -> DataFrame:
    """One row per session. ``landings`` carry is_out and side."""
    k = ["session_id"]
    land = landings.groupBy(*k).agg(
        F.count("*").alias("total_bounces"), F.count_if(~F.col("is_out")).alias("bounces_in"), F.count_if("is_out").alias("bounces_out"),
        *[F.count_if((F.col("side") == s) & c).alias(f"{s}_{n}") for s in ("near", "far") for n, c in (("total", F.lit(True)), ("in", ~F.col("is_out")))])
    base = points.groupBy(*k).agg(F.count("*").alias("total_frames"))
    seen = rally_rows.groupBy(*k, "rally").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("d")).groupBy(*k).agg(
        F.count("*").alias("rally_count"), F.sum("n").alias("rally_frames"), F.sum("d").alias("play_s"))
    sp = speeds.groupBy(*k).agg(F.avg("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed"))
    out = base.join(seen, k, "left").join(shots.groupBy(*k).agg(F.sum("shots").alias("total_shots")), k, "left").join(sp, k, "left").join(land, k, "left")
    return out.na.fill(0)


def player_movement(play: DataFrame, side: str, low: float = 0.05, high: float = 0.5, cap: float = 7.0) -> DataFrame:
    """Distance and speeds of one player; steps below noise or beyond belief are ignored.

    The previous seen position may be any number of frames back.
    """
    from ..functions.geometry import hypot
    from .ordered import neighbour

    x, y = f"{side}_x", f"{side}_y"
    t = neighbour(play.where(F.col(x).isNotNull()), ["session_id"], "frame", prev={"_p": (None, F.struct(x, y, "ts"))})
    d = hypot(F.col(x) - F.col("_p")[x], F.col(y) - F.col("_p")[y])
    dt = F.col("ts") - F.col("_p.ts")
    ok = d.between(low, high)
    t = t.withColumns({"_d": F.when(ok, d), "_v": F.when(ok & (dt > 0.001), F.least(d / dt, F.lit(cap)))})
    s = t.groupBy("session_id").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("distance"), F.coalesce(F.max("_v"), F.lit(0.0)).alias("max_speed"),
                                    (F.max("ts") - F.min("ts")).alias("_span"), F.count("*").alias("_n"))
    length = F.when(F.col("_span") > 0.001, F.col("_span")).otherwise(F.col("_n") / 25.0)
    return s.withColumn("avg_speed", F.col("distance") / length).drop("_span", "_n").withColumn("side", F.lit(side))


def result_matrix(play: DataFrame) -> DataFrame:
    """Hits, serves and bounces inside the court; the first near-half hit of a session is the serve."""
    from .predicates import BALL_SPEED, clamp_speed, hand_type, norm_x, norm_y

    nx, ny = norm_x(F.col("x")), norm_y(F.col("y"))
    t = play.where(F.col("is_bounce") | F.col("is_hit")).withColumns({"nx": nx, "ny": ny})
    t = t.where((F.col("nx") > 0) & (F.col("nx") < 1) & (F.col("ny") > 0) & (F.col("ny") < 1) & (F.col("is_bounce") | (F.col("speed_kmh") >= BALL_SPEED[0])))
    hit = ~F.col("is_bounce")
    first = t.where(hit & (F.col("ny") < 0.5)).groupBy("session_id").agg(F.min("frame").alias("_serve"))
    t = t.join(first, "session_id", "left")
    kind = F.when(F.col("is_bounce"), "bounce").when(F.col("frame") == F.col("_serve"), "serve").otherwise("hit")
    hand = F.when(hit, hand_type(F.col("keypoints"))).otherwise("forehand") if "keypoints" in play.columns else F.lit("forehand")
    return t.select("session_id", "frame", "nx", "ny", kind.alias("kind"), F.bround(clamp_speed(F.col("speed_kmh")), 0).cast("long").alias("speed"), hand.alias("hand"))


def track_matrix(play: DataFrame) -> DataFrame:
    """Every frame with ball, state and the last known player positions (fixed defaults before)."""
    from .ordered import neighbour, row_index
    from .predicates import clamp_speed, norm_x, norm_y

    t = play.withColumns({f"_{s}": F.when(F.col(f"{s}_x").isNotNull(), F.struct(norm_x(F.col(f"{s}_x")).alias("x"), norm_y(F.col(f"{s}_y")).alias("y"))) for s in ("near", "far")})
    t = neighbour(t, ["session_id"], "frame", prev={f"_l{s}": (F.col(f"_{s}").isNotNull(), F.col(f"_{s}")) for s in ("near", "far")})
    default = {"near": (0.5, 0.95), "far": (0.5, 0.05)}
    pos = {f"{s}_{c}n": F.coalesce(F.col(f"_{s}")[c], F.col(f"_l{s}")[c], F.lit(default[s][i])) for s in default for i, c in enumerate("xy")}
    state = F.when(F.col("is_bounce"), "bounce").when(F.col("is_hit"), "hit").otherwise("running")
    t = row_index(t, ["session_id"], "frame", "timestamp").withColumns(pos)
    return t.select("session_id", "frame", "timestamp", norm_x(F.col("x")).alias("bx"), norm_y(F.col("y")).alias("by"), state.alias("state"),
                    F.bround(clamp_speed(F.col("speed_kmh")), 0).cast("long").alias("speed"), *pos)


def thin_evenly(indexed: DataFrame, keys: Sequence[str], idx: str, size: int) -> DataFrame:
    """At most ``size`` rows per key at rounded even positions, renumbered from zero."""
    n = indexed.groupBy(*keys).agg(F.count("*").alias("_n"))
    k = F.least(F.col("_n"), F.lit(size))
    slots = n.select(*keys, "_n", F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))).alias("slot"))
    pick = F.when(F.col("_n") <= size, F.col("slot")).otherwise(F.bround(F.col("slot") * ((F.col("_n") - 1).cast("double") / (size - 1)), 0)).cast("long")
    slots = slots.select(*keys, pick.alias(idx), "slot")
    return indexed.join(slots, [*keys, idx]).drop(idx).withColumnRenamed("slot", idx)


def side_statistics(result: DataFrame, side: str) -> DataFrame:
    """Serve, return, zone and ace figures of one side from the ordered result rows.

    Row positions (not first equal entries) define "next"; the first-serve figure counts the
    landings of all serves, over this side's serves.
    """
    from .ordered import neighbour
    from .stats import ratio

    k = ["session_id"]
    mine = (F.col("ny") < 0.5) if side == "near" else (F.col("ny") >= 0.5)
    stroke = F.col("kind").isin("hit", "serve")
    box = F.when(F.lit(side == "near"), F.col("b")["ny"].between(0.6, 0.9)).otherwise(F.col("b")["ny"].between(0.1, 0.4))
    t = neighbour(result, k, "frame", next={
        "b": (F.col("kind") == "bounce", F.struct("frame", "nx", "ny")), "mine_next": (stroke & mine, F.col("frame")),
        "opp_next": (stroke & ~mine, F.col("frame")), "serve_next": (F.col("kind") == "serve", F.col("frame"))})
    after = t.select("session_id", F.col("frame").alias("mine_next"), F.col("b.ny").alias("_rny"))
    t = t.join(after, ["session_id", "mine_next"], "left")
    in_box = F.coalesce(box & F.col("b.nx").between(0.15, 0.85), F.lit(False))
    is_serve = F.col("kind") == "serve"
    opp_land = (F.col("_rny") >= 0.5) if side == "near" else (F.col("_rny") < 0.5)
    unreturned = F.col("opp_next").isNull() | (F.col("serve_next").isNotNull() & (F.col("opp_next") > F.col("serve_next")))
    deep = F.when(F.lit(side == "far"), F.col("ny")).otherwise(1 - F.col("ny"))
    s = t.groupBy(*k).agg(
        F.count_if(stroke & mine).alias("total_shots"), F.count_if(is_serve & mine).alias("serves"), F.count_if(is_serve & in_box).alias("serves_in"),
        F.count_if(is_serve & ~mine).alias("received"), F.count_if(is_serve & ~mine & F.coalesce(opp_land, F.lit(False))).alias("returned"),
        F.count_if(stroke & mine & (deep >= 0.8)).alias("baseline_hits"), F.count_if(stroke & mine & (deep <= 0.2)).alias("net_hits"),
        F.count_if(is_serve & mine & in_box & unreturned).alias("aces"), F.avg(F.when(stroke & mine & F.col("speed").between(50, 150), F.col("speed"))).alias("avg_speed"))
    return s.withColumns({
        "first_serve_pct": 100 * ratio(F.col("serves_in"), F.col("serves")), "return_pct": 100 * ratio(F.col("returned"), F.col("received")),
        "baseline_pct": 100 * ratio(F.col("baseline_hits"), F.col("total_shots")), "net_pct": 100 * ratio(F.col("net_hits"), F.col("total_shots")), "side": F.lit(side)})


def display_feed(points: DataFrame, bounces: DataFrame, crossings: DataFrame, rally_rows: DataFrame) -> DataFrame:
    """Dense frames between a session's first and last, typed, with the speed of the nearest
    earlier crossing on bounces. The frame range is unrolled in pieces, so no row grows with it."""
    from .joins import asof

    k = ["session_id"]
    span = points.groupBy(*k).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    piece = 4096
    s = span.select(*k, "a", "b", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(piece))).alias("s"))
    s = s.select(*k, F.explode(F.sequence(F.col("s"), F.least(F.col("s") + piece - 1, F.col("b")))).alias("frame"))
    flag = lambda d, n: d.select(*k, "frame", F.lit(True).alias(n)).distinct()
    s = s.join(flag(bounces, "_b"), [*k, "frame"], "left").join(flag(crossings, "_c"), [*k, "frame"], "left").join(flag(rally_rows, "_r"), [*k, "frame"], "left")
    kind = F.when(F.col("_b"), "bounce").when(F.col("_c"), "net_crossing").when(F.col("_r"), "rally").otherwise("none")
    s = asof(s.select(*k, "frame", kind.alias("kind")), crossings, k, "frame", {"speed": F.col("speed_kmh")})
    return s.withColumn("speed", F.when(F.col("kind") == "bounce", F.col("speed")))


def feature_profile(points: DataFrame, bounces: DataFrame, fps: float = 25.0) -> DataFrame:
    """Distribution figures of speed, height, crossings, landings, arcs and rhythm per session."""
    from ..functions.geometry import hypot
    from .joins import interval_join
    from .ordered import neighbour, windowed
    from .stats import with_quantiles

    k = ["session_id"]

    def build(t: DataFrame, w) -> DataFrame:
        dt = (F.col("frame") - F.lag("frame").over(w)) / fps
        d = lambda c: (F.col(c) - F.lag(c).over(w)) / dt
        near = dt <= 3 / fps
        v, h, py = hypot(d("x"), d("y"), d("z")), hypot(d("x"), d("y")), F.lag("y").over(w)
        side = ((py < 0) & (F.col("y") > 0)) | ((py > 0) & (F.col("y") < 0))
        ok = lambda c, lo: F.when(near & (c > lo) & (c < 80), c)
        return t.withColumns({"v": ok(v, 1), "h": ok(h, 1), "c": F.when(side, ok(v, 5))})

    t = windowed(points, k, "frame", build, 3, 0)
    s = t.groupBy(*k).agg(
        F.avg("v").alias("speed_mean"), F.stddev_pop("v").alias("speed_std"), F.avg("z").alias("height_mean"), F.stddev_pop("z").alias("height_std"), F.max("z").alias("height_max"),
        F.avg("c").alias("cross_speed_mean"), F.count("c").alias("cross_count"), F.avg("h").alias("h_speed_mean"), F.stddev_pop("h").alias("h_speed_std"))
    s = with_quantiles(s, t, k, "v", {"speed_median": 0.5, "speed_p90": 0.9})
    b = neighbour(bounces, k, "frame", next={"nf": (None, F.col("frame"))})
    gap = (F.col("nf") - F.col("frame"))
    land = b.groupBy(*k).agg(F.count("*").alias("bounce_count"), F.avg("z").alias("bounce_z_mean"), F.avg("x").alias("land_x_mean"), F.stddev_pop("x").alias("land_x_std"),
                             F.avg(F.when(gap < 100, gap / fps)).alias("interval_mean"))
    arcs = interval_join(points.select(*k, "frame", F.col("z").alias("_z")), b.where("nf IS NOT NULL").select(*k, F.col("frame").alias("f0"), "nf"), k, "frame", "f0", "nf", 256)
    arcs = arcs.groupBy(*k, "f0").agg(F.max("_z").alias("top")).groupBy(*k).agg(F.avg("top").alias("arc_mean"))
    return s.join(land, k, "left").join(arcs, k, "left")
