"""Filters side by side, and lags by block products, against numpy."""

import random

import numpy as np

from arcline.operators import align as AL
from arcline.operators import compare as C


def test_polynomials_of_any_degree(spark):
    r = random.Random(4)
    rows = [(g, i, n, r.gauss(0, 1) + i * i) for g, n in ((1, 1), (2, 3), (3, 5), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, n long, v double")
    for degree in (1, 2, 4):
        got = {(x.g, x.i): x.v_poly for x in C.polynomial(df, ["g"], "i", "n", {"v": degree}).collect()}
        for g in (1, 2, 3, 4):
            v = [x[3] for x in rows if x[0] == g]
            want = np.polyval(np.polyfit(range(len(v)), v, degree), range(len(v))) if len(v) > degree + 1 else v
            assert max(abs(got[g, i] - w) for i, w in enumerate(want)) < 1e-6


def test_lags_over_blocks(spark, monkeypatch):
    """Every lag's sums, for gappy series over several blocks, one session without enough overlap."""
    r = random.Random(8)
    fa, fb = (sorted(r.sample(range(900), 500)) for _ in "ab")
    a, b = ({f: r.random() + (f % 37) for f in fa}, {f: r.random() + ((f + 11) % 37) for f in fb})
    da = spark.createDataFrame([(1, f, v) for f, v in a.items()] + [(2, 5, 1.0)], "session_id long, frame long, v double")
    db = spark.createDataFrame([(1, f, v) for f, v in b.items()] + [(2, 5, 1.0)], "session_id long, frame long, v double")
    got = {x.lag: x.n for x in AL.lag_sums(da.where("session_id = 1"), db, 60, block=128).collect()}
    pairs = {lag: [(a[f], b[f - lag]) for f in fa if f - lag in b] for lag in range(-60, 61)}
    assert {k: int(n) for k, n in got.items()} == {lag: len(p) for lag, p in pairs.items() if p}
    best = max(pairs, key=lambda lag: (round(float(np.corrcoef(*zip(*pairs[lag]))[0, 1]), 9), -lag))
    monkeypatch.setattr(AL, "LAG_BLOCK", 128)
    res = {x.session_id: x for x in AL.best_lag(da, db, 60).collect()}
    assert res[1].best_lag == best and res[1].n == len(pairs[best]) and abs(res[1].corr - np.corrcoef(*zip(*pairs[best]))[0, 1]) < 1e-9
    assert res[2].best_lag is None


def test_bounded_search_finds_the_grid_best(spark, monkeypatch):
    """The best of all shifts of the grid, over small blocks; few shifts are left to measure."""
    from pyspark.sql import functions as F

    from arcline.plans.fixtures import CAM_A, CAM_B, table
    from tests.conftest import SF

    a, b = (table(spark, SF, n).where("frame < 300") for n in ("det66", "det68"))
    b = b.withColumn("frame", F.col("frame") - 3)
    cams, grid = table(spark, SF, "cams"), [round(-0.6 + 0.04 * i, 6) for i in range(31)]
    full = {(r.session_id, r.dt): r.cost for r in AL.sweep_time_offsets(a, b, cams, CAM_A, CAM_B, grid).collect()}
    monkeypatch.setattr(AL, "LAG_BLOCK", 64)
    left = {tuple(r) for r in AL.likely_offsets(a, b, cams, CAM_A, CAM_B, grid).collect()}
    for s in {k[0] for k in full}:
        best = min((round(c, 9), dt) for (x, dt), c in full.items() if x == s)
        assert (s, best[1]) in left and best[1] == 0.12
    assert len(left) < len(full) / 3
    got = {r.session_id: r for r in AL.best_time_offset(a, b, cams, CAM_A, CAM_B, half_range=0.6, steps=31).collect()}
    assert all(r.cost <= full[s, 0.12] + 1e-9 and abs(r.dt - 0.12) <= 0.2 for s, r in got.items())
