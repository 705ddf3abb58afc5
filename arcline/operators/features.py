"""Dense per-frame features, label smoothing and training windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import hypot
from .ordered import BLK, OWN, neighbour, segments, spread, windowed

KEYS = ["session_id"]
WINDOWS = (10, 25, 50, 100)
LOOKBACKS = (25, 50, 100, 200)


def dense_frames(spans: DataFrame, keys: Sequence[str] = KEYS, piece: int = 4096) -> DataFrame:
    """All frames from 0 to ``last`` of each key, unrolled in pieces."""
    s = spans.select(*keys, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(piece).cast("long"))).alias("_s"))
    return s.select(*keys, F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + piece - 1, F.col("last")))).alias("frame"))


def frame_labels(truth: DataFrame, frames: DataFrame) -> DataFrame:
    """1 where a frame is annotated, else 0, for every dense frame."""
    t = truth.select(*KEYS, "frame", F.lit(1).alias("_l")).distinct()
    return frames.join(t, [*KEYS, "frame"], "left").select(*KEYS, "frame", F.coalesce("_l", F.lit(0)).alias("label"))


#: Rows whose windows are laid out at once: their arrays stay in the processor's cache.
CHUNK = 128


def _mid_power(h: np.ndarray, win: int, own: np.ndarray) -> np.ndarray:
    """Share of the spectrum between a tenth and half of the bins of the 0/1 rows around each row of ``own``."""
    half, n = win // 2, len(h)
    out = np.zeros(n)

    def share(s: np.ndarray) -> np.ndarray:
        if s.shape[1] <= 4:
            return np.zeros(len(s))
        p = np.abs(np.fft.rfft(s - s.mean(1, keepdims=True))) ** 2
        lo, hi, total = max(1, p.shape[1] // 10), p.shape[1] // 2, p.sum(1)
        return np.where(total > 0, p[:, lo:hi].sum(1) / np.where(total > 0, total, 1.0), 0.0) if hi > lo else np.zeros(len(s))

    whole = own[(own >= half) & (own + half <= n)]
    for at in np.array_split(whole, len(whole) // CHUNK + 1):
        if len(at):
            out[at] = share(np.lib.stride_tricks.sliding_window_view(h, win)[at - half])
    for i in own[(own < half) | (own + half > n)]:  # cut at an end of the session
        out[i] = share(h[None, max(0, i - half):i + half])[0]
    return out


def _window_features(t: pd.DataFrame) -> dict[str, np.ndarray]:
    """Steps and window features of the dense, ordered rows of one bordered block."""
    n, h, h68 = len(t), t["h66"].to_numpy(float), t["h68"].to_numpy(float)
    on = h == 1
    x, y, iv = (t[c].to_numpy(float) for c in ("pixel_x", "pixel_y", "_iv"))
    lag = lambda v, first=np.nan: np.concatenate([[first], v[:-1]])
    dx, dy = x - lag(x), y - lag(y)
    vel = np.nan_to_num(np.sqrt(dx * dx + dy * dy))
    flip = (dy * lag(dy) < 0).astype(float)
    out = {"vel_x": np.nan_to_num(dx), "vel_y": np.nan_to_num(dy), "vel": vel, "accel": np.abs(vel - lag(vel, 0.0))}
    row = np.arange(n)

    def counted(v: np.ndarray, before: int, after: int) -> np.ndarray:
        """Window sums of whole numbers, exact as differences of running sums."""
        c = np.concatenate([[0.0], np.cumsum(v)])
        return c[np.minimum(row + after + 1, n)] - c[np.maximum(row - before, 0)]

    iv = np.where(on, np.nan_to_num(iv), 0.0)
    first = np.minimum.accumulate(np.where(on, row, n)[::-1])[::-1]  # the next detection at or after a row
    for win in WINDOWS:
        half = win // 2
        size, n66 = counted(np.ones(n), half, half), counted(h, half, half)
        many = n66 > 1
        start = np.minimum(first[np.maximum(row - half, 0)], n - 1)
        inner = np.maximum(n66 - 1, 1)
        mean = (counted(iv, half, half) - iv[start]) / inner
        var = (counted(iv * iv, half, half) - iv[start] ** 2) / inner - mean * mean
        got = {c: np.zeros(n) for c in ("mean_sum", "mean_max", "mean_area", "mean_vel", "std_vel", "y_range", "x_range", "std_x", "std_y", "max_gap")}
        views = {c: np.lib.stride_tricks.sliding_window_view(np.pad(v, half, constant_values=np.nan), 2 * half + 1) for c, v in (
            ("mean_sum", np.where(on, t["blob_sum"], np.nan)), ("mean_max", np.where(on, t["blob_max"], np.nan)), ("mean_area", np.where(on, t["blob_area"], np.nan)),
            ("mean_vel", vel), ("std_vel", np.where(on, vel, np.nan)), ("x", x), ("y", y), ("iv", np.where(on, iv, np.nan)))}
        for lo in range(0, n, CHUNK):
            part = slice(lo, min(lo + CHUNK, n))

            def stats(c):
                v = views[c][part]
                ok = ~np.isnan(v)
                k = np.maximum(ok.sum(1), 1)
                return v, ok, k, np.where(ok, v, 0.0).sum(1) / k

            def spread_of(v, ok, k, m):
                return np.sqrt((np.where(ok, v - m[:, None], 0.0) ** 2).sum(1) / k)

            def span(v, ok, *_):
                return np.where(ok, v, -np.inf).max(1) - np.where(ok, v, np.inf).min(1)

            for c in ("mean_sum", "mean_max", "mean_area", "mean_vel"):
                got[c][part] = stats(c)[3]
            got["std_vel"][part] = spread_of(*stats("std_vel"))
            for c in "xy":
                s = stats(c)
                got[f"std_{c}"][part], got[f"{c}_range"][part] = spread_of(*s), span(*s)
            gaps = np.where(np.isnan(views["iv"][part]), -np.inf, views["iv"][part])
            gaps[np.arange(len(gaps)), np.clip(start[part] - (row[part] - half), 0, 2 * half)] = -np.inf  # reaches out of the window
            got["max_gap"][part] = gaps.max(1)
        for c in ("std_vel", "y_range", "x_range", "std_x", "std_y"):
            got[c] = np.where(many, got[c], 0.0)
        got["max_gap"] = np.where(many, got["max_gap"], float(win))
        out |= {f"{c}_{win}": v for c, v in got.items()} | {
            f"density_{win}": n66 / size, f"density68_{win}": counted(h68, half, half) / size, f"xcam_{win}": counted(h * h68, half, half) / np.maximum(n66, 1),
            f"flips_{win}": counted(flip, half, half).astype("int64"), f"mean_gap_{win}": np.where(many, mean, float(win)),
            f"regularity_{win}": np.where(many, np.sqrt(np.maximum(var, 0.0)), float(win))}
    for back in LOOKBACKS:
        out[f"rate_{back}"] = counted(h, back, 0) / counted(np.ones(n), back, 0)
    for win in (50, 100):
        out[f"power_{win}"] = _mid_power(h, win, np.flatnonzero(t[OWN].to_numpy(bool)))
    return out


def rally_features(a: DataFrame, b: DataFrame, spans: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Features of every frame from one camera's detections and the other's presence; ``labels`` of dense frames ride along.

    ``a``: frame, pixel_x, pixel_y, blob_sum, blob_max, blob_area, n_blobs. Frames are dense, so
    all windows reach a fixed number of rows and bordered blocks are exact; only the distances
    to the nearest detection and run lengths look further, as two-level scans.
    """
    d = dense_frames(spans).join(a, [*KEYS, "frame"], "left").join(b.select(*KEYS, "frame", F.lit(1).alias("_h68")).distinct(), [*KEYS, "frame"], "left")
    if labels is not None:  # joined while rows are narrow
        d = d.join(labels, [*KEYS, "frame"])
    has = F.col("pixel_x").isNotNull()
    d = d.withColumns({"h66": has.cast("int"), "h68": F.coalesce("_h68", F.lit(0))}).drop("_h68")
    d = neighbour(d, KEYS, "frame",
                  prev={"_pd": (F.col("h66") == 1, F.col("frame")), "_p0": (F.col("h66") == 0, F.col("frame"))},
                  next={"_nd": (F.col("h66") == 1, F.col("frame")), "_n0": (F.col("h66") == 0, F.col("frame"))})
    d = d.join(spans.select(*KEYS, "last"), KEYS)
    f, on = F.col("frame"), F.col("h66") == 1
    d = d.withColumns({
        "gap_before": F.when(on, 0).otherwise(f - F.coalesce("_pd", F.lit(-999))),
        "gap_after": F.when(on, 0).otherwise(F.coalesce("_nd", F.col("last") + 1 + 999) - f),
        "run_length": F.when(on, f - F.coalesce("_p0", F.lit(-1))).otherwise(0),
        "total_run": F.when(on, F.coalesce("_n0", F.col("last") + 1) - F.coalesce("_p0", F.lit(-1)) - 1).otherwise(0),
        "_iv": F.when(on, f - F.col("_pd"))})

    # narrow rows go into one pass over each bordered block: no list of a window is ever a column
    blobs = ["blob_sum", "blob_max", "blob_area", "n_blobs"]
    kept = [*KEYS, "frame", *blobs, "h66", "h68", "gap_before", "gap_after", "run_length", "total_run", *(["label"] if labels is not None else []), "pixel_x", "pixel_y"]
    d = d.select(*kept, "_iv").withColumns({c: F.col(c).cast("double") for c in [*blobs, "_iv"]})
    per = ("density", "density68", "mean_sum", "mean_max", "mean_area", "mean_vel", "std_vel", "xcam", "y_range", "x_range", "std_x", "std_y", "flips", "regularity", "mean_gap", "max_gap")
    made = ["vel_x", "vel_y", "vel", "accel", *[f"{c}_{w}" for w in WINDOWS for c in per], *[f"rate_{b}" for b in LOOKBACKS], "power_50", "power_100"]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[OWN].to_numpy(bool)
        if not own.any():  # a border without rows of its own
            return pd.DataFrame({c: [] for c in [*kept, *made]})
        order = np.argsort(pdf["frame"].to_numpy(), kind="stable")
        pdf, own = pdf.take(order).reset_index(drop=True), own[order]
        got = _window_features(pdf)
        return pd.DataFrame({c: pdf[c].to_numpy()[own] for c in kept} | {c: got[c][own] for c in made})

    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField(c, T.LongType() if c.startswith("flips") else T.DoubleType()) for c in made])
    t = spread(d, "frame", max(LOOKBACKS) + 3, max(WINDOWS) // 2 + 1).groupBy(*KEYS, BLK).applyInPandas(block, schema)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = t.withColumns({
        "min_gap": F.least("gap_before", "gap_after"), "both": F.col("h66") * F.col("h68"), "px_norm": zero(F.col("pixel_x") / 1920.0), "py_norm": zero(F.col("pixel_y") / 1080.0),
        **{c: zero(F.col(c).cast("double")) for c in ("blob_sum", "blob_max", "blob_area", "n_blobs")}})
    return t.drop("pixel_x", "pixel_y")


def _runs(df: DataFrame, label: str) -> DataFrame:
    """Length of each run of equal labels on dense frames, and whether it touches an end."""
    change = lambda w: F.col(label) != F.lag(label).over(w)
    s = segments(df, KEYS, "frame", 1, "_run", change)
    r = s.groupBy(*KEYS, "_run").agg(F.count("*").alias("_len"), F.max("frame").alias("_end"))
    ends = df.groupBy(*KEYS).agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    r = r.join(ends, KEYS).withColumn("_edge", (F.col("_run") == F.col("_lo")) | (F.col("_end") == F.col("_hi")))
    return s.join(r.select(*KEYS, "_run", "_len", "_edge"), [*KEYS, "_run"])


def smooth_labels(df: DataFrame, label: str = "label", min_gap: int = 10, min_run: int = 5) -> DataFrame:
    """Fill short zero runs between ones, then drop short runs of ones."""
    filled = _runs(df, label).withColumn(label, F.when((F.col(label) == 0) & ~F.col("_edge") & (F.col("_len") < min_gap), 1).otherwise(F.col(label)))
    filled = filled.drop("_run", "_len", "_edge")
    kept = _runs(filled, label).withColumn(label, F.when((F.col(label) == 1) & (F.col("_len") < min_run), 0).otherwise(F.col(label)))
    return kept.drop("_run", "_len", "_edge")


def training_windows(rows: DataFrame, label: str, half: int = 12, fps: float = 25.0) -> DataFrame:
    """Fourteen normalised motion features per row, gathered over the rows around each labelled row.

    ``rows``: session, frame, idx (dense), a_x, a_y, b_x, b_y pixel positions (0 where absent).
    """
    base = {f"{c}{v}": F.col(f"{c}_{v}") / (1920.0 if v == "x" else 1080.0) for c in "ab" for v in "xy"}

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        z = lambda c: F.coalesce(c, F.lit(0.0))
        t = t.withColumns(base)
        t = t.withColumns({f"d{c}{v}": z((F.col(f"{c}{v}") - F.lag(f"{c}{v}").over(w)) * fps) for c in "ab" for v in "xy"})
        t = t.withColumns({f"q{c}{v}": z((F.col(f"d{c}{v}") - F.lag(f"d{c}{v}").over(w)) * fps) for c in "ab" for v in "xy"})
        t = t.withColumns({f"s{c}": hypot(F.col(f"d{c}x"), F.col(f"d{c}y")) for c in "ab"})
        feats = [f"{p}{c}{v}" for p in ("", "d", "q") for c in "ab" for v in "xy"] + ["sa", "sb"]
        return t.withColumn("window", F.collect_list(F.array(*feats)).over(w.rowsBetween(-half, half)))

    t = windowed(rows, KEYS, "idx", build, half + 3, half)
    return t.where(F.size("window") == 2 * half + 1).select(*KEYS, "frame", F.col(label).alias("label"), "window")


def balance_classes(df: DataFrame, label: str, rest: str, factor: int = 5, order: Sequence[str] = ("session_id", "frame")) -> DataFrame:
    """Every class at ``factor`` times the largest event class: events repeated, the rest thinned.

    Which rows go beyond whole repeats is decided by a hash threshold: a row takes one more copy
    when its hash falls below the remaining share, so class sizes are met in expectation and no
    class is ever sorted. The class counts are a few rows and go to every task: dealt by label, all rows of a class
    would meet in one.
    """
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = n.where(F.col(label) != rest).agg((F.max("_n") * factor).alias("_target"))
    share = n.join(top, F.lit(True)).withColumn("_share", F.when((F.col(label) == rest), F.least(F.lit(1.0), F.col("_target") / F.col("_n"))).otherwise(F.col("_target") / F.col("_n")))
    u = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("_share") + (u < F.col("_share") - F.floor("_share")).cast("long")
    t = df.join(F.broadcast(share.select(label, "_share")), label).withColumn("_k", copies).where("_k > 0")
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))).drop("_k", "_share")


def split_by_match(df: DataFrame, match: str, own: Column, val_pct: int = 20, order: Column | None = None) -> DataFrame:
    """Own recordings train; of the other matches ``val_pct`` percent (rounded down, one at least) validate.

    Which ones is drawn by a stable hash of the match, or by ``order``.
    """
    m = df.where(~own).select(match).distinct()
    count = max(1, m.count() * val_pct // 100)
    drawn = m.orderBy(order if order is not None else F.xxhash64(match), match).limit(count).withColumn("_v", F.lit(True))
    t = df.join(drawn, match, "left")
    return t.withColumn("part", F.when(F.coalesce("_v", F.lit(False)) & ~own, "val").otherwise("train")).drop("_v")


# ---- classifiers ----------------------------------------------------------------------------

FEATURES = [f"{n}_{w}" for w in WINDOWS for n in ("density", "mean_sum", "mean_vel", "std_vel", "xcam", "y_range", "x_range", "regularity", "flips", "mean_gap")] + [
    "gap_before", "gap_after", "run_length", "total_run", "vel", "accel", "rate_25", "rate_100", "px_norm", "py_norm"]


def train_rally_models(features: DataFrame, label: str = "label", trees: int = 40, depth: int = 6):
    """Random forest with balanced weights and boosted trees with a positive-class weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    share = features.agg(F.avg(F.col(label).cast("double")).alias("p"))
    w = features.join(share, F.lit(True)).withColumns({
        "w_rf": F.when(F.col(label) == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p"))),
        "w_gbt": F.when(F.col(label) == 1, (1 - F.col("p")) / F.col("p")).otherwise(1.0), "y": F.col(label).cast("double")})
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rf = RandomForestClassifier(labelCol="y", weightCol="w_rf", numTrees=trees, maxDepth=depth, seed=42, probabilityCol="p_rf", rawPredictionCol="r_rf", predictionCol="c_rf")
    gbt = GBTClassifier(labelCol="y", weightCol="w_gbt", maxIter=10, maxDepth=4, seed=42)
    gbt = gbt.setProbabilityCol("p_gbt").setRawPredictionCol("r_gbt").setPredictionCol("c_gbt")
    return Pipeline(stages=[vec, rf, gbt]).fit(w)


def rally_probability(model, features: DataFrame) -> DataFrame:
    """Mean positive probability of the models."""
    from pyspark.ml.functions import vector_to_array

    t = model.transform(features)
    p = (vector_to_array("p_rf")[1] + vector_to_array("p_gbt")[1]) / 2
    keep = [*KEYS, "frame"] + (["label"] if "label" in features.columns else [])
    return t.select(*keep, p.alias("prob"))


def predicted_rallies(prob: DataFrame, threshold: float = 0.42) -> DataFrame:
    """Thresholded, smoothed rally flags on dense frames."""
    return smooth_labels(prob.withColumn("rally", (F.col("prob") >= threshold).cast("int")), "rally")
