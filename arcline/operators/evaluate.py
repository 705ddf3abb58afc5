"""Comparing detections, events and labels with ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import hypot
from ..session import Kept
from .groups import linked_groups
from .joins import match_one_to_one
from .ordered import segments, windowed
from .stats import prf, quantiles, ratio, with_quantiles

KEYS = ["session_id"]
FRAME = ["session_id", "frame"]


def frame_errors(truth: DataFrame, det: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Each truth frame with its detection's pixel error and verdict (miss when absent)."""
    d = det.select(*FRAME, F.col("pixel_x").alias("_dx"), F.col("pixel_y").alias("_dy"))
    err = hypot(F.col("_dx") - F.col("pixel_x"), F.col("_dy") - F.col("pixel_y"))
    j = truth.join(d, FRAME, "left").withColumn("error", err)
    verdict = F.when(F.col("error").isNull(), "miss").when(F.col("error") <= threshold, "correct").otherwise("wrong")
    return j.withColumn("verdict", verdict).drop("_dx", "_dy")


def graded(error: Column, good: float = 10.0, bad: float = 50.0) -> Column:
    return F.when(error.isNull(), "miss").when(error <= good, "correct").when(error <= bad, "offset").otherwise("wrong")


def accuracy_report(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    s = errors.groupBy(*by).agg(
        F.count("*").alias("total"), is_("correct").alias("correct"), is_("wrong").alias("wrong"), is_("miss").alias("missed"),
        F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))
    s = with_quantiles(s, errors, by, "error", {"median_error": 0.5})
    return s.withColumns({f"{c}_rate": ratio(F.col(c), F.col("total")) for c in ("correct", "wrong", "missed")})


def detection_scores(truth: DataFrame, det: DataFrame, threshold: float, wrong_counts_as: str = "fn",
                     extra_counts_as_fp: bool = True, by: Sequence[str] = KEYS) -> DataFrame:
    """P / R / F1 per group; a detection too far off counts as a miss or as a false alarm."""
    by = list(by)
    e = frame_errors(truth, det, threshold).groupBy(*by).agg(
        F.count_if(F.col("verdict") == "correct").alias("tp"), F.count_if(F.col("verdict") == "wrong").alias("wrong"),
        F.count_if(F.col("verdict") == "miss").alias("miss"), F.avg(F.when(F.col("verdict") == "correct", F.col("error"))).alias("mean_px"))
    extra = det.join(truth.select(*FRAME), FRAME, "left_anti").groupBy(*by).agg(F.count("*").alias("extra"))
    s = e.join(extra, by, "left").withColumn("extra", F.coalesce("extra", F.lit(0)) if extra_counts_as_fp else F.lit(0))
    fn = F.col("miss") + (F.col("wrong") if wrong_counts_as == "fn" else F.lit(0))
    fp = F.col("extra") + (F.col("wrong") if wrong_counts_as == "fp" else F.lit(0))
    s = s.withColumns({"fn": fn, "fp": fp})
    return s.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).drop("wrong", "miss", "extra")


def tracking_scores(truth: DataFrame, det: DataFrame, threshold: float = 30.0, jump: float = 30.0) -> DataFrame:
    """Detection scores, pixel accuracy shares, and jitter over consecutive truth frames."""
    s = detection_scores(truth, det, threshold)
    e = frame_errors(truth, det, threshold).where("verdict = 'correct'")
    share = {f"pct_{k}": ratio(F.count_if(F.col("error") < k), F.count("*")) * 100 for k in (5, 10, 20)}
    acc = e.groupBy(*KEYS).agg(*[c.alias(n) for n, c in share.items()])
    acc = with_quantiles(acc, e, KEYS, "error", {"median_px": 0.5})
    on_truth = det.select(*FRAME, "pixel_x", "pixel_y").join(truth.select(*FRAME), FRAME, "left_semi")
    move = windowed(on_truth, KEYS, "frame", lambda t, w: t.withColumn("move", F.when(
        F.col("frame") - F.lag("frame").over(w) == 1, hypot(*[F.col(c) - F.lag(c).over(w) for c in ("pixel_x", "pixel_y")]))), 1, 0)
    jit = move.groupBy(*KEYS).agg(F.avg("move").alias("jitter"), (100 * ratio(F.count_if(F.col("move") > jump), F.count("move"))).alias("large_jump_pct"))
    return s.join(acc, KEYS, "left").join(jit, KEYS, "left")


def event_recall(truth: DataFrame, det: DataFrame, event: str, threshold: float = 30.0) -> DataFrame:
    """Recall of annotated frames per event kind and session (1.0 where a kind is absent)."""
    e = frame_errors(truth, det, threshold)
    return e.groupBy(*KEYS, event).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "correct").alias("hit")).withColumn(
        "recall", ratio(F.col("hit"), F.col("total"), 1.0))


def miss_gaps(truth: DataFrame, det: DataFrame, threshold: float = 30.0, max_step: int = 2) -> DataFrame:
    """Runs of missed truth frames at most ``max_step`` apart."""
    missed = frame_errors(truth, det, threshold).where("verdict = 'miss'").select(*FRAME)
    s = segments(missed, KEYS, "frame", max_step, "start")
    return s.groupBy("session_id", "start").agg(F.max("frame").alias("end"), F.count("*").alias("length"))


def coverage(truth: DataFrame, points: DataFrame, gap: int = 5) -> DataFrame:
    """Share of tracked frames inside each run of truth frames."""
    s = segments(truth.select(*FRAME), KEYS, "frame", gap, "start")
    s = s.join(points.select(*FRAME, F.lit(1).alias("_t")), FRAME, "left")
    return s.groupBy("session_id", "start").agg(F.max("frame").alias("end"), F.count("*").alias("n_truth"), F.count("_t").alias("n_tracked")).withColumn(
        "pct", 100 * F.col("n_tracked") / F.col("n_truth"))


def match_events(truth: DataFrame, det: DataFrame, tolerance: int = 5, driver: str = "truth", policy: str = "nearest_unused") -> DataFrame:
    """Matched pairs with landing error; driver truth or det (see ``match_one_to_one``)."""
    a, b = (truth, det) if driver == "truth" else (det, truth)
    m = match_one_to_one(a, b, KEYS, "frame", tolerance, policy).where(F.col("partner_at").isNotNull())
    g, d = ("driver_at", "partner_at") if driver == "truth" else ("partner_at", "driver_at")
    m = m.select("session_id", F.col(g).alias("gt_frame"), F.col(d).alias("det_frame"))
    t = truth.select("session_id", F.col("frame").alias("gt_frame"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    e = det.select("session_id", F.col("frame").alias("det_frame"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    j = m.join(t, ["session_id", "gt_frame"]).join(e, ["session_id", "det_frame"])
    return j.withColumns({"frame_diff": F.abs(F.col("gt_frame") - F.col("det_frame")), "error_m": hypot(F.col("gx") - F.col("dx"), F.col("gy") - F.col("dy"))})


def event_metrics(matches: DataFrame, truth: DataFrame, det: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Counts, P / R / F1 and landing error statistics per group (index rule for p95)."""
    by = list(by)
    n = lambda d, c: d.groupBy(*by).agg(F.count("*").alias(c))
    s = n(truth, "gt_count").join(n(det, "detected"), by, "full_outer").join(
        matches.groupBy(*by).agg(F.count("*").alias("matched"), F.avg("error_m").alias("error_mean")), by, "left")
    s = s.na.fill(0, ["gt_count", "detected", "matched"])
    s = s.withColumns({"missed": F.col("gt_count") - F.col("matched"), "false_positives": F.col("detected") - F.col("matched")})
    s = s.withColumns(prf(F.col("matched"), F.col("false_positives"), F.col("missed")))
    s = s.join(quantiles(matches, by, "error_m", {"error_median": 0.5}), by, "left")
    return s.join(quantiles(matches, by, "error_m", {"error_p95": 0.95}, rule="index"), by, "left")


def rank_methods(metrics: DataFrame) -> DataFrame:
    """Method comparison: best F1 first, recall breaks ties (one row per method, a small table)."""
    w = Window.orderBy(F.desc(F.round("f1", 4)), F.desc(F.round("recall", 4)), "method")
    return metrics.withColumn("rank", F.row_number().over(w))


def recall_at(truth: DataFrame, cands: DataFrame, ks: Sequence[int] = (1, 3, 5), threshold: float = 30.0) -> DataFrame:
    """Recall of ranked candidates within the first k, against all truth points of the frame."""
    c = cands.select(*FRAME, "rank", F.col("pixel_x").alias("_cx"), F.col("pixel_y").alias("_cy"))
    d = truth.join(c, FRAME, "left").withColumn("_d", hypot(F.col("_cx") - F.col("pixel_x"), F.col("_cy") - F.col("pixel_y")))
    f = d.groupBy(*FRAME).agg(F.count("rank").alias("n"), F.countDistinct("rank").alias("n_blobs"), *[F.min(F.when(F.col("rank") < k, F.col("_d"))).alias(f"d{k}") for k in ks])
    s = f.groupBy(*KEYS).agg(
        F.count("*").alias("gt_frames"), F.count_if(F.col("n") == 0).alias("no_detection"),
        *[ratio(F.count_if(F.col(f"d{k}") <= threshold), F.count("*")).alias(f"recall_{k}") for k in ks],
        F.avg("d1").alias("mean_top1"), ratio(F.count_if(F.col("n_blobs") > 1), F.count_if(F.col("n") > 0)).alias("multi_rate"))
    return with_quantiles(s, f, KEYS, "d1", {"median_top1": 0.5})


def nearest_truth(truth: DataFrame, det: DataFrame, name: str) -> DataFrame:
    """Smallest distance of a frame's detection to any truth point of the frame."""
    t = truth.select(*FRAME, F.col("pixel_x").alias("_gx"), F.col("pixel_y").alias("_gy"))
    j = det.join(t, FRAME).groupBy(*FRAME)
    return j.agg(F.min(hypot(F.col("pixel_x") - F.col("_gx"), F.col("pixel_y") - F.col("_gy"))).alias(name))


def rerank_impact(truth: DataFrame, before: DataFrame, after: DataFrame, threshold: float = 30.0, margin: float = 1.0) -> DataFrame:
    j = nearest_truth(truth, before, "a").join(nearest_truth(truth, after, "b"), FRAME)
    a, b = F.col("a"), F.col("b")
    return j.groupBy(*KEYS).agg(
        F.count("*").alias("total"), F.count_if(b < a - margin).alias("improved"), F.count_if(b > a + margin).alias("degraded"),
        F.count_if(F.abs(a - b) <= margin).alias("no_change"), F.count_if((a > threshold) & (b <= threshold)).alias("rescued"),
        F.count_if((a <= threshold) & (b > threshold)).alias("killed"))


def stability(det: DataFrame, truth: DataFrame, jump: float = 30.0, max_gap: int = 2) -> DataFrame:
    """Displacement of close rows; big jumps are split by what the truth did in between."""
    xy = ("pixel_x", "pixel_y")
    t = truth.select(*FRAME, F.struct(*xy).alias("_g"))
    d = det.select(*FRAME, *xy).join(t, FRAME, "left")

    def build(t: DataFrame, w) -> DataFrame:
        g, p = F.col("_g"), F.lag("_g").over(w)
        near = F.col("frame") - F.lag("frame").over(w) <= max_gap
        return t.withColumns({
            "disp": F.when(near, hypot(*[F.col(c) - F.lag(c).over(w) for c in xy])),
            "gt_disp": hypot(*[g[c] - p[c] for c in xy])})

    t = windowed(d, KEYS, "frame", build, max_gap, 0).where(F.col("disp").isNotNull())
    big = F.col("disp") > jump
    known = F.col("gt_disp").isNotNull()
    real = F.col("gt_disp") > jump / 2
    s = t.groupBy(*KEYS).agg(
        F.count("*").alias("total_pairs"), F.count_if(big).alias("jumps"), F.count_if(big & known & real).alias("real_jumps"),
        F.count_if(big & known & ~real).alias("drift"), F.count_if(big & ~known).alias("unverifiable"), F.avg("disp").alias("mean_disp"))
    s = with_quantiles(s, t, KEYS, "disp", {"median_disp": 0.5})
    return s.withColumn("stability_rate", 1 - F.col("drift") / F.col("total_pairs"))


def stationary(det: DataFrame, rows: int = 5, max_spread: float = 8.0) -> DataFrame:
    """Flag every row inside a near-consecutive window whose positions barely differ.

    ``window_start`` marks the first row of such a window, ``still`` any row covered by one.
    """

    def spread(a: Column) -> Column:
        per = F.transform(a, lambda p: F.array_max(F.transform(a, lambda q: hypot(p["x"] - q["x"], p["y"] - q["y"]))))
        return F.array_max(per)

    def build(t: DataFrame, w) -> DataFrame:
        win = F.collect_list(F.struct(F.col("pixel_x").alias("x"), F.col("pixel_y").alias("y"))).over(w.rowsBetween(0, rows - 1))
        span = F.lead("frame", rows - 1).over(w) - F.col("frame")
        t = t.withColumn("_w", F.when(span <= rows + 1, win))
        t = t.withColumn("window_start", F.coalesce(spread(F.col("_w")) < max_spread, F.lit(False)))
        return t.withColumn("still", F.max("window_start").over(w.rowsBetween(-(rows - 1), 0))).drop("_w")

    return windowed(det, KEYS, "frame", build, rows + 1, rows + 1)


def dead_ball_report(det: DataFrame, truth: DataFrame, threshold: float = 30.0, **kw) -> DataFrame:
    s = stationary(det, **kw)
    d = nearest_truth(truth, det, "d")
    j = s.join(d, FRAME, "left")
    dead = F.col("still") & (F.col("d") > threshold)
    return j.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count_if("window_start").alias("windows"), F.count_if("still").alias("still_rows"), F.count_if(dead).alias("dead_rows"),
        F.count_if(F.col("still") & (F.col("d") <= threshold)).alias("correct_still")).withColumn("dead_rate", F.col("dead_rows") / F.col("n"))


def static_clusters(cands: DataFrame, cell: float = 25.0, min_frames: int = 30) -> DataFrame:
    """Places seen in many distinct frames: (session, camera, cx, cy of the first cell, cells, frames, x, y).

    Positions are counted by pixel cells. A cell with a quarter of ``min_frames`` (a ball on a corner has one of four)
    and every cell that touches it with a mean position at most ``cell`` away are one place. Distinct frames come
    from the (frame, cell) pre-aggregate, so a busy cell never meets in one task.
    """
    cam, kept = ["session_id", "camera"], Kept(cands.sparkSession)
    cx, cy = F.floor(F.col("pixel_x") / cell).cast("long"), F.floor(F.col("pixel_y") / cell).cast("long")
    per = kept.keep(cands.groupBy(*cam, cx.alias("cx"), cy.alias("cy"), "frame").agg(F.sum("pixel_x").alias("sx"), F.sum("pixel_y").alias("sy"), F.count("*").alias("n")))
    c = per.groupBy(*cam, "cx", "cy").agg(F.count("*").alias("frames"), (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"))
    c = kept.keep(c.withColumn("core", F.col("frames") >= -(-min_frames // 4)))
    kept.tidy()
    # a core cell meets the eight around it; of two core cells the one that follows meets the other
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])).alias("d")
    a = c.where("core").select(*cam, F.struct("cx", "cy").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", ahead)
    a = a.select(*cam, "a", "ax", "ay", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    links = a.join(c, [*cam, "cx", "cy"]).where((~F.col("core") | (F.col("a") > F.struct("cx", "cy"))) & (hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= cell))
    group = linked_groups(links.select(*cam, "a", F.struct("cx", "cy").alias("b")), cam, kept=kept)
    group = group.select(*cam, F.col("node.cx").alias("cx"), F.col("node.cy").alias("cy"), "label")
    lone = c.select(*cam, "cx", "cy", F.col("frames").alias("most")).join(group, [*cam, "cx", "cy"], "left").withColumn("label", F.coalesce("label", F.struct("cx", "cy")))
    # the frames of a place are at most those of its cells together, so most cells are left here
    cells = kept.keep(lone.groupBy(*cam, "label").agg(F.count("*").alias("cells"), F.sum("most").alias("most")).where(F.col("most") >= min_frames).drop("most"))
    lone = kept.keep(lone.drop("most").join(cells.drop("cells"), [*cam, "label"], "left_semi"), c)
    kept.tidy()
    rows = per.join(lone, [*cam, "cx", "cy"]).groupBy(*cam, "label", "frame").agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("n").alias("n"))
    out = rows.groupBy(*cam, "label").agg(F.count("*").alias("frames"), (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"))
    out = out.join(cells, [*cam, "label"]).where(F.col("frames") >= min_frames)
    out = kept.keep(out.select(*cam, "label.cx", "label.cy", "cells", "frames", "x", "y"))
    kept.only(out)
    kept.tidy()
    return out


def penalised_top1(cands: DataFrame, clusters: DataFrame, radius: float = 30.0, cell: float = 25.0, penalty: float = 0.5) -> DataFrame:
    """Best candidate per frame after a penalty near any static cluster.

    The distance test is an equi-join on neighbouring cells (radius within two cells each way).
    """
    reach = int(radius // cell) + 1
    around = F.sequence(F.lit(-reach), F.lit(reach))
    c = clusters.select("session_id", "camera", F.col("x").alias("_x"), F.col("y").alias("_y"))
    c = c.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    c = c.withColumns({"_cx": F.floor(F.col("_x") / cell) + F.col("_i"), "_cy": F.floor(F.col("_y") / cell) + F.col("_j")})
    t = cands.withColumns({"_cx": F.floor(F.col("pixel_x") / cell), "_cy": F.floor(F.col("pixel_y") / cell)})
    key = ["session_id", "camera", "frame", "rank"]
    near = F.coalesce(hypot(F.col("pixel_x") - F.col("_x"), F.col("pixel_y") - F.col("_y")) <= radius, F.lit(False)).alias("_near")
    t = t.select(*key, "pixel_x", "pixel_y", "conf", "_cx", "_cy").join(c, ["session_id", "camera", "_cx", "_cy"], "left").select(*key, "pixel_x", "pixel_y", "conf", near)
    # a candidate comes once for each cluster around it; both groupings are served by one shuffle by frame
    s = t.repartition("session_id", "camera", "frame").groupBy(*key).agg(F.max_by(F.struct("pixel_x", "pixel_y", "conf"), F.struct("conf")).alias("c"), F.bool_or("_near").alias("_near"))
    s = s.select(*key, "c.*", (F.col("c.conf") - F.when(F.col("_near"), penalty).otherwise(0.0)).alias("score"))
    pick = F.max_by(F.struct("rank", "pixel_x", "pixel_y", "score"), F.struct("score", -F.col("rank")))
    return s.groupBy("session_id", "camera", "frame").agg(pick.alias("p")).select("session_id", "camera", "frame", "p.*")


def detector_summary(matches: DataFrame, truth: DataFrame, det: DataFrame, frames: DataFrame) -> DataFrame:
    """Confusion counts with approximate true negatives, in-court agreement and error spread."""
    n = lambda d, c: d.groupBy(*KEYS).agg(F.count("*").alias(c))
    g, d = F.col("gt_in"), F.col("det_in")
    m = matches.groupBy(*KEYS).agg(
        F.count("*").alias("tp"), F.count_if(g & d).alias("in_in"), F.count_if(g & ~d).alias("in_out"),
        F.count_if(~g & d).alias("out_in"), F.count_if(~g & ~d).alias("out_out"), F.max("frame_diff").alias("max_lag"))
    s = n(frames, "n_frames").join(n(truth, "n_gt"), KEYS, "left").join(n(det, "n_det"), KEYS, "left").join(m, KEYS, "left").na.fill(0)
    s = s.withColumns({"fn": F.col("n_gt") - F.col("tp"), "fp": F.col("n_det") - F.col("tp")})
    s = s.withColumn("tn", F.greatest(F.lit(0), F.col("n_frames") - F.col("n_gt") - F.col("fp")))
    return with_quantiles(s, matches, KEYS, "error_m", {"err_median": 0.5, "err_p90": 0.9})


def compare_runs(a: DataFrame, b: DataFrame, same_px: float = 5.0) -> DataFrame:
    """Frame sets and pixel differences of two runs per session."""
    l = a.select(*FRAME, F.col("pixel_x").alias("ax"), F.col("pixel_y").alias("ay"))
    r = b.select(*FRAME, F.col("pixel_x").alias("bx"), F.col("pixel_y").alias("by"))
    j = l.join(r, FRAME, "full_outer").withColumn("diff", hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    s = j.groupBy(*KEYS).agg(
        F.count("diff").alias("common"), F.count_if(F.col("bx").isNull()).alias("only_a"), F.count_if(F.col("ax").isNull()).alias("only_b"),
        F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"), F.count_if(F.col("diff") <= same_px).alias("same"))
    s = with_quantiles(s, j, KEYS, "diff", {"median_diff": 0.5})
    share = ratio(F.col("same"), F.col("common"))
    return s.withColumn("verdict", F.when(share >= 0.95, "equal").when(share >= 0.8, "close").otherwise("different"))


def run_verdicts(truth: DataFrame, a: DataFrame, b: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Per truth frame, which of two runs is right."""
    ea = frame_errors(truth, a, threshold).select(*FRAME, (F.col("verdict") == "correct").alias("a_ok"))
    eb = frame_errors(truth, b, threshold).select(*FRAME, (F.col("verdict") == "correct").alias("b_ok"))
    v = F.when(F.col("a_ok") == F.col("b_ok"), "SAME").when(F.col("a_ok"), "A+").otherwise("B+")
    return ea.join(eb, FRAME).withColumn("outcome", v)


def agreement_matrix(errors: DataFrame, distances: DataFrame, edges: tuple[float, float] = (1.0, 3.0)) -> DataFrame:
    """Camera agreement zone against correctness of the detection."""
    d = F.col("dist")
    zone = F.when(d.isNull(), "single").when(d < edges[0], "agree").when(d < edges[1], "uncertain").otherwise("disagree")
    j = errors.join(distances, FRAME, "left").withColumn("zone", zone)
    return j.groupBy(*KEYS, "zone").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("n"))


def ray_profile(points: DataFrame, thresholds: Sequence[float] = (0.25, 0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Cumulative share of ray distances below each threshold: one pass, then unpivoted."""
    cols = {f"t{i}": F.count_if(F.col("ray_dist") < t) for i, t in enumerate(thresholds)}
    s = points.groupBy(*KEYS).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in cols.items()])
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("below")) for i, t in enumerate(thresholds)])
    return s.select(*KEYS, "n", F.explode(arr).alias("e")).select(*KEYS, "n", "e.*").withColumn("share", F.col("below") / F.col("n"))


def class_metrics(df: DataFrame, label: str, pred: str, ignore: str) -> DataFrame:
    """Per-class P / R / F1 from the confusion counts, plus accuracy and macro-F1 without one class."""
    cm = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    side = lambda c, n, cond=None: cm.where(cond if cond is not None else F.lit(True)).groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(n))
    t = side("l", "support").join(side("p", "predicted"), "class", "full_outer").join(side("l", "tp", F.col("l") == F.col("p")), "class", "left").na.fill(0)
    t = t.withColumns(prf(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")))
    allw = Window.partitionBy()
    return t.withColumns({
        "accuracy": F.sum("tp").over(allw) / F.sum("support").over(allw),
        "macro_f1": F.avg(F.when(F.col("class") != ignore, F.col("f1"))).over(allw)})


def sweep_thresholds(df: DataFrame, score: str, label: str, grid: Sequence[float], by: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy at every threshold in one aggregation pass, and the best (lowest on ties)."""
    aggs = [F.avg(((F.col(score) >= t) == F.col(label)).cast("double")).alias(f"a{i}") for i, t in enumerate(grid)]
    s = df.groupBy(*by).agg(*aggs)
    arr = F.array(*[F.struct(F.round(F.col(f"a{i}"), 9).alias("accuracy"), F.lit(-float(t)).alias("neg")) for i, t in enumerate(grid)])
    best = F.array_max(arr)
    return s.select(*by, (-best["neg"]).alias("threshold"), best["accuracy"].alias("accuracy"))
