"""Serves, shots and single-camera landings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..court import COURT
from ..functions.geometry import hypot
from ..session import cut_lineage
from .cooldown import first_wins
from .joins import band_join
from .ordered import row_index, segments, windowed
from .peaks import find_peaks, suppress_by_score

KEYS = ["session_id"]


def long_segments(df: DataFrame, gap: int = 3, min_rows: int = 5) -> DataFrame:
    """Rows of gap-free segments with enough rows; ``seg`` joins the key."""
    s = segments(df, KEYS, "frame", gap)
    keep = s.groupBy(*KEYS, "seg").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(*KEYS, "seg")
    return s.join(keep, [*KEYS, "seg"], "left_semi")


def extrema_bounces(track: DataFrame, wy_prom: float = 0.5, py_prom: float = 8.0, rows: int = 5, cooldown: int = 8,
                    band: tuple[float, float] = (-9.885, 20.115), min_py: float = 100.0) -> DataFrame:
    """Landings from turning points of the ground y and maxima of the image y, first one wins."""
    seg = [*KEYS, "seg"]
    s = long_segments(track).withColumns({"_neg": -F.col("world_y"), "_wy": F.col("world_y")})
    s = cut_lineage(row_index(s, seg, "frame"))  # read for each kind of peak
    inside = (F.col("world_y") > band[0]) & (F.col("world_y") < band[1])
    parts = [
        find_peaks(s, seg, "_wy", rows, wy_prom).where(inside).withColumns({"_o": F.lit(0), "side": F.lit("far")}),
        find_peaks(s, seg, "_neg", rows, wy_prom).where(inside).withColumns({"_o": F.lit(1), "side": F.lit("near")}),
        find_peaks(s, seg, "pixel_y", rows, py_prom).where(F.col("pixel_y") > min_py).withColumns({"_o": F.lit(2), "side": F.lit("near")})]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = u.groupBy(*KEYS, "frame").agg(F.min_by(F.struct("world_x", "world_y", "pixel_x", "pixel_y", "side"), "_o").alias("r"))
    return first_wins(one, KEYS, cooldown).select(*KEYS, "frame", "r.*")


def agreement_bounces(a: DataFrame, b: DataFrame, max_dist: float = 4.0, prominence: float = 1.0, rows: int = 5, cooldown: int = 8) -> DataFrame:
    """Landings where the two cameras' ground points come closest."""
    o = b.select(*KEYS, "frame", F.col("world_x").alias("_ox"), F.col("world_y").alias("_oy"))
    j = a.join(o, [*KEYS, "frame"]).withColumn("dist", hypot(F.col("world_x") - F.col("_ox"), F.col("world_y") - F.col("_oy")))
    s = long_segments(j.select(*KEYS, "frame", "world_x", "world_y", "dist")).withColumn("_neg", -F.col("dist"))
    p = find_peaks(s, [*KEYS, "seg"], "_neg", rows, prominence).where(F.col("dist") <= max_dist)
    return first_wins(p, KEYS, cooldown).select(*KEYS, "frame", "world_x", "world_y", "dist", F.when(F.col("world_y") < 0, "near").otherwise("far").alias("side"))


def serves(track: DataFrame, gap: int = 15, look: int = 40, zone: float = COURT.baseline_zone, leave: float = 2.0) -> DataFrame:
    """After a pause that ends behind a baseline: the last row in that zone before the ball leaves.

    The look ahead spans ``look`` frames and as many rows from the first one, so one bordered window suffices.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("frame").over(w)
        ahead = w.rangeBetween(0, look)
        return t.withColumns({
            "_start": prev.isNull() | (F.col("frame") - prev > gap),
            "_rows": F.when(prev.isNull() | (F.col("frame") - prev > gap), F.collect_list(F.struct("frame", "world_x", "world_y")).over(ahead))})

    t = windowed(track.select(*KEYS, "frame", "world_x", "world_y"), KEYS, "frame", build, gap + 1, look + 1)
    near, far = F.col("world_y") < -zone, F.col("world_y") > zone
    t = t.where(F.col("_start") & (near | far)).withColumn("side", F.when(near, "near").otherwise("far"))
    sgn = F.when(F.col("side") == "near", -1.0).otherwise(1.0)
    # walk: "out" once the ball is clearly inside the court, "hit" = last row still in the zone
    acc0 = F.struct(F.lit(False).alias("out"), F.struct("frame", "world_x", "world_y").alias("hit"))

    def walk(acc: Column, s: Column) -> Column:
        deep = s["world_y"] * sgn
        gone = acc["out"] | (deep < zone - leave)
        return F.struct(gone.alias("out"), F.when(~gone & (deep > zone), s).otherwise(acc["hit"]).alias("hit"))

    t = t.withColumn("h", F.aggregate(F.slice("_rows", 1, look), acc0, walk)["hit"])
    return t.select(*KEYS, F.col("frame").alias("start_frame"), "h.*", "side")


def shots(track: DataFrame, bounces: DataFrame, serve_rows: DataFrame, min_turn: float = 0.4, cooldown: int = 10, around_bounce: int = 5,
          around_serve: int = 8, ratio: float = 2.0, min_speed: float = 0.3, gap: int = 5) -> DataFrame:
    """Direction reversals and abrupt speed changes away from landings and serves, best first."""

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        b, a = F.col("frame") - F.lag("frame").over(w), F.lead("frame").over(w) - F.col("frame")
        v = {}
        for c in "xy":
            v[f"_{c}b"] = (F.col(f"world_{c}") - F.lag(f"world_{c}").over(w)) / b
            v[f"_{c}a"] = (F.lead(f"world_{c}").over(w) - F.col(f"world_{c}")) / a
        return t.withColumns(v | {"_ok": (b <= gap) & (a <= gap)})

    t = windowed(track, KEYS, "frame", build, gap + 1, gap + 1).where("_ok")
    flip = F.col("_yb") * F.col("_ya") < 0
    sb, sa = hypot(F.col("_xb"), F.col("_yb")), hypot(F.col("_xa"), F.col("_ya"))
    slow = F.least(sb, sa)
    t = t.withColumns({"method": F.when(flip, "reversal").otherwise("velocity"),
                       "score": F.when(flip, F.abs(F.col("_ya") - F.col("_yb"))).otherwise(F.abs(sa - sb)),
                       "_hit": F.when(flip, F.abs(F.col("_ya") - F.col("_yb")) > min_turn).otherwise((slow >= min_speed) & (F.greatest(sb, sa) >= ratio * slow))})
    t = t.where("_hit").select(*KEYS, "frame", "world_x", "world_y", "method", "score")
    bf = bounces.select(*KEYS, F.col("frame").alias("_f"))
    sf = serve_rows.select(*KEYS, F.col("frame").alias("_f"))
    rev = band_join(t.where("method = 'reversal'"), bf, KEYS, "frame", "_f", around_bounce, around_bounce, "left_anti")
    vel = band_join(t.where("method = 'velocity'"), bf, KEYS, "frame", "_f", 2, 2, "left_anti")
    c = band_join(rev.unionByName(vel), sf, KEYS, "frame", "_f", around_serve, around_serve, "left_anti")
    return suppress_by_score(c, KEYS, "frame", cooldown, "score")
