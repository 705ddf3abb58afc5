"""Peak finding and non-maximum suppression on long series, exact and block-parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import BLK, OWN, row_index, running, spread, windowed

#: Rows that one call of the prominence check takes on average.
ROWS = 50_000


def suppress_by_score(cand: DataFrame, keys: Sequence[str], order: str, min_gap: int, score: str, rounds: int = 3) -> DataFrame:
    """Score-first suppression: take the best candidate, drop those nearer than ``min_gap``, repeat.

    A candidate that beats everything undecided within reach is final at once, so all chains
    advance in parallel; a pass does ``rounds`` such steps and the rest goes round again.
    Ties go to the later candidate.
    """
    names = cand.columns
    todo = cand.withColumn("_st", F.lit(0))
    done = None
    while True:
        reach = 2 * rounds * (min_gap - 1)

        def build(t: DataFrame, w) -> DataFrame:
            near = w.rangeBetween(-(min_gap - 1), min_gap - 1)
            for _ in range(rounds):
                rank = F.when(F.col("_st") == 0, F.struct(F.col(score).alias("s"), F.col(order).alias("o")))
                t = t.withColumn("_win", F.coalesce(rank == F.max(rank).over(near), F.lit(False)))
                t = t.withColumn("_st", F.when(F.col("_win"), 1).when((F.col("_st") == 0) & F.max("_win").over(near), 2).otherwise(F.col("_st")))
            return t.drop("_win")

        # copies of a row near a block border may lag behind the row itself; only own rows are kept
        todo = cut_lineage(windowed(todo, keys, order, build, reach, reach))
        kept = todo.where("_st = 1").select(*names)
        done = kept if done is None else done.unionByName(kept)
        todo = todo.where("_st = 0")
        if todo.isEmpty():
            return done


def find_peaks(df: DataFrame, keys: Sequence[str], value: str, distance: int = 1, prominence: float = 0.0, order: str = "frame",
               reach: int = 512) -> DataFrame:
    """Rows that are local maxima of ``value`` (plateau middles included), thinned so that higher
    peaks clear lower ones nearer than ``distance`` rows, with at least ``prominence``.

    Uses the dense row position ``idx`` when present, else adds it.
    """
    keys = list(keys)
    v = F.col(value)

    def shape(t: DataFrame, w) -> DataFrame:
        return t.withColumns({
            "_up": v > F.lag(value).over(w), "_down": v > F.lead(value).over(w),
            "_new": F.coalesce(v != F.lag(value).over(w), F.lit(True)), "_last": F.lead("idx").over(w).isNull()})

    base = df if "idx" in df.columns else row_index(df, keys, order)
    # several branches below read the rows; each prefix scan would otherwise recompute its input
    rows = cut_lineage(windowed(base, keys, "idx", shape, 1, 1))
    runs = running(rows, keys, "idx", maxes={"_run": F.when(F.col("_new"), F.struct("idx", "_up"))})
    top = runs.where(F.col("_down") & F.col("_run._up"))
    mid = F.floor((F.col("_run.idx") + F.col("idx")) / 2).cast("long")
    flat = top.where(F.col("_run.idx") < F.col("idx")).select(*keys, mid.alias("idx"))
    cols = [*[c for c in df.columns if c != "idx"], "idx"]
    peaks = top.where(F.col("_run.idx") == F.col("idx")).select(*cols).unionByName(rows.join(flat, [*keys, "idx"], "left_semi").select(*cols))
    if distance > 1:
        peaks = suppress_by_score(peaks, keys, "idx", distance, value)
    if prominence <= 0:
        return peaks
    flags = rows.select(*keys, "idx", v.alias("_v"), "_last").join(peaks.select(*keys, "idx", F.lit(1).alias("_pk")), [*keys, "idx"], "left")
    good = None
    while True:
        ok = cut_lineage(_prominent(flags, keys, prominence, reach))
        sure = ok.where("_ok = 1").select(*keys, "idx")
        good = sure if good is None else good.unionByName(sure)
        unsure = ok.where("_ok = 2").select(*keys, "idx")
        if unsure.isEmpty():
            return peaks.join(good, [*keys, "idx"], "left_semi")
        # few peaks need a wider look; widen it for them alone
        reach *= 16
        flags = flags.drop("_pk").join(unsure.withColumn("_pk", F.lit(1)), [*keys, "idx"], "left")


def _prominent(flags: DataFrame, keys: Sequence[str], prominence: float, reach: int) -> DataFrame:
    """1 where both sides fall by ``prominence`` before rising above the peak, 0 where not, 2 when
    the look ended undecided inside the series.

    A task takes many blocks at a time, about ``ROWS`` rows, as series may be a few rows long.
    """
    part = [*keys, BLK]
    t = spread(flags, "idx", reach, reach, block=max(16 * reach, 1024))
    fields = [f for f in t.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("idx", T.LongType()), T.StructField("_ok", T.IntegerType())])

    def side(vals: np.ndarray, h: float, at_end: bool) -> int:
        over, low = np.flatnonzero(vals > h), np.flatnonzero(vals <= h - prominence)
        stop = over[0] if len(over) else len(vals)
        if len(low) and low[0] < stop:
            return 1
        return 0 if len(over) or at_end else 2

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*part, "idx"], ignore_index=True)
        v, idx, last = pdf["_v"].to_numpy(float), pdf["idx"].to_numpy(), pdf["_last"].to_numpy(bool)
        block = pdf.groupby(part, sort=False, dropna=False).ngroup().to_numpy()
        at = np.flatnonzero(pdf["_pk"].notna().to_numpy() & pdf[OWN].to_numpy(bool))
        low, high = np.searchsorted(block, block[at]), np.searchsorted(block, block[at], side="right")
        ok = []
        for i, a, b in zip(at, low, high):
            p = (side(v[a:i][::-1], v[i], idx[a] == 0), side(v[i + 1:b], v[i], bool(last[b - 1])))
            ok.append(0 if 0 in p else max(p))
        return pdf.loc[at, [*keys, "idx"]].assign(_ok=np.array(ok, dtype="int32"))[schema.names]

    tasks = max(1, flags.count() // ROWS)
    return t.withColumn("_task", F.pmod(F.xxhash64(*part), F.lit(tasks))).groupBy("_task").applyInPandas(judge, schema)


def smooth3(df: DataFrame, keys: Sequence[str], col: str, name: str, order: str = "idx") -> DataFrame:
    """Mean of three neighbour rows; the first and last row stand in for their missing neighbour.

    ``order`` must be a dense row position.
    """
    return windowed(df, keys, order, lambda t, w: t.withColumn(name, (
        F.coalesce(F.lag(col).over(w), F.col(col)) + F.col(col) + F.coalesce(F.lead(col).over(w), F.col(col))) / 3), 1, 1)


def peak_positions(values: list[float], distance: int, prominence: float) -> list[int]:
    """Peaks of a short list (one detector's buffer): same rules as ``find_peaks``."""
    runs, i = [], 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        runs.append((values[i], i, j))
        i = j + 1
    tops = [(v, (a + b) // 2) for (p, _, _), (v, a, b), (n, _, _) in zip(runs, runs[1:], runs[2:]) if p < v > n]
    kept: list[int] = []
    for v, k in sorted(tops, reverse=True):
        if all(abs(k - q) >= distance for q in kept):
            kept.append(k)

    def drop(side: list[float], v: float) -> float:
        low = v
        for u in side:
            if u > v:
                break
            low = min(low, u)
        return v - low

    return sorted(k for k in kept if min(drop(values[:k][::-1], values[k]), drop(values[k + 1:], values[k])) >= prominence)
