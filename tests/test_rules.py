"""Hand-made scenarios and brute-force comparisons for rules without an SQL twin."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from arcline.operators import ordered
from arcline.operators import peaks as PK
from arcline.operators import rally as R
from arcline.operators import tracks as TR
from arcline.operators.fold import fold
from arcline.operators.stats import quantiles
from arcline.streaming import live as L


def play(rows):
    """rows: (t, y, z[, bounce x, bounce y, inside]); returns the closed points and the state."""
    state, out = R.point_state(), []
    for i, row in enumerate(rows):
        b = row[3:] if len(row) > 3 else (None, None, None)
        out += R.point_step(state, SimpleNamespace(frame=i, t=row[0], y=row[1], z=row[2], ray_dist=0.1, b_x=b[0], b_y=b[1], b_in=b[2]))
    return out, state


SERVE = [(1.00, -9.0, 1.2), (1.04, -9.1, 1.1), (1.08, -9.2, 1.0), (1.12, -2.0, 1.5), (1.16, 2.0, 1.4)]


def test_serve_starts_at_the_first_pending_row():
    out, s = play(SERVE[:3])
    assert not out and s["mode"] == "serving" and s["rally"]["f"] == 0 and s["rally"]["server"] == "near"


def test_joining_mid_flight_counts_the_crossing():
    _, s = play([(2.0, -1.0, 1.2), (2.04, 0.8, 1.1)])
    assert s["mode"] == "rally" and s["rally"]["n"] == 1 and s["rally"]["f"] == 0


def test_fault_then_double_fault():
    wide = (1.20, 7.0, 0.1, 0.0, 9.0, True)
    out, s = play([*SERVE, wide])
    assert not out and s["rally"]["attempt"] == 2 and s["mode"] == "serving"
    again = [(1.3, -9.0, 1.2), (1.34, -2.0, 1.2), (1.38, 2.0, 1.2), (1.42, 7.0, 0.1, 0.0, 9.0, True)]
    out, s = play([*SERVE, wide, *again])
    assert [o[6] for o in out] == ["double_fault"]


def test_let_replays_the_same_attempt():
    touch = [(1.12, -1.0, 1.0), (1.16, 0.5, 0.5), (1.20, 4.0, 0.1, 0.0, 4.0, True)]
    _, s = play([*SERVE[:3], *touch])
    assert s["mode"] == "serving" and s["rally"]["attempt"] == 1


def test_out_double_bounce_timeout_and_net():
    good = (1.20, 4.0, 0.1, 0.0, 4.0, True)
    out, _ = play([*SERVE, good, (1.4, -3.0, 1.0), (1.5, -5.0, 0.1, 5.0, -5.0, False)])
    assert out[0][6] == "out"
    out, _ = play([*SERVE, good, (1.3, 8.0, 0.1, 0.0, 8.0, True)])
    assert out[0][6:8] == ("double_bounce", "far")
    out, _ = play([*SERVE, good, (6.0, 4.0, 1.0)])
    assert out[0][6] == "timeout"
    out, _ = play([*SERVE, good, (1.3, 1.2, 1.2), (1.34, 1.0, 0.5)])
    assert out[0][6] == "net"


def test_repeats_are_rejected(spark):
    rows = [(1, 0, 10.0, -3.0, -8.0), (1, 5, 10.2, 3.0, -8.0), (2, 0, 10.0, -3.0, -8.0), (2, 5, 10.2, -1.5, -8.3), (3, 0, 10.0, -3.0, -8.0), (3, 5, 10.2, -2.8, -8.0)]
    got = {(r.session_id, r.frame): r.verdict for r in R.accepted_bounces(spark.createDataFrame(rows, "session_id long, frame long, t double, x double, y double")).collect()}
    assert got[1, 5] == "accepted" and got[2, 5] == "f2_min_interval" and got[3, 5] == "duplicate"


def test_fold_equals_one_pass_in_any_chunking(spark):
    rng = random.Random(7)
    vals = [rng.random() for _ in range(600)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "session_id long, frame long, v double")

    def step(state, row):
        state["s"] = state["s"] * 0.9 + row.v if row.v > 0.05 else 0.0
        return [(int(row.frame), state["s"])]

    want, state = [], {"s": 0.0}
    for i, v in enumerate(vals):
        want += step(state, SimpleNamespace(frame=i, v=v))
    for block in (37, 5000):
        got = fold(df, ["session_id"], "frame", {"s": 0.0}, step, "frame long, s double", block=block).orderBy("frame").collect()
        assert [(r.frame, r.s) for r in got] == want


def test_peaks_match_the_list_rule(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 50)
    rng = random.Random(3)
    vals = [round(rng.random() * 4) / 4 for _ in range(400)]
    df = spark.createDataFrame([(1, i * 3, v) for i, v in enumerate(vals)], "session_id long, frame long, v double")
    got = sorted(r.frame // 3 for r in PK.find_peaks(df, ["session_id"], "v", 5, 0.5, reach=8).collect())
    assert got == PK.peak_positions(vals, 5, 0.5)


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    vals = [rng.gauss(0, 3) for _ in range(501)]
    df = spark.createDataFrame([(1, v) for v in vals], "k long, v double")
    row = quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()[0]
    s = sorted(vals)
    assert abs(row.a - s[250]) < 1e-12 and abs(row.b - s[450]) < 1e-12
    assert quantiles(df, ["k"], "v", {"p": 0.95}, rule="index").collect()[0].p == s[int(501 * 0.95)]


def test_best_path_prefers_the_moving_ball(spark):
    rows = []
    for f in range(8):
        rows.append((1, f, 0, 0, 0.0, -6.0 + f * 1.2, 1.0, 0.5))
        rows.append((1, f, 1, 1, 3.0, 4.0, 0.5, 0.1))
    df = spark.createDataFrame(rows, "session_id long, frame long, a_rank int, b_rank int, x double, y double, z double, ray_dist double")
    for block in (3, 1000):
        ordered_block, ordered.BLOCK = ordered.BLOCK, block
        try:
            got = TR.best_paths(df).orderBy("frame").collect()
        finally:
            ordered.BLOCK = ordered_block
        assert [r.a_rank for r in got] == [0] * 8


def test_stream_equals_batch(spark):
    from arcline.plans.registry import QUERIES
    from tests.conftest import SF

    s, b = (QUERIES[n](spark, SF) for n in ("x4_stream_crossings", "x4_batch_crossings"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.select(*s.columns).collect()))


def test_hot_session_spreads_over_partitions(spark):
    df = spark.range(0, 40000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("frame"))
    t = ordered.spread(df, "frame", 8, 8, 500)
    per = t.groupBy("_blk").count().agg(F.max("count")).collect()[0][0]
    assert per <= 516 and t.where("_own").count() == 40000


def test_baseline_zone_is_five_metres(spark):
    from arcline.operators.predicates import baseline_zone

    rows = spark.createDataFrame([(y,) for y in (-6.8, -6.9, 0.0, 6.8, 6.9, 8.0)], "y double")
    assert [r[0] for r in rows.select(baseline_zone(F.col("y"))).collect()] == [False, True, False, False, True, True]


def test_all_tracks_match(spark):
    """Sixty tracks a camera, all seen by both: none is left out."""
    rows = []
    for k in range(60):
        for f in range(12):
            rows.append((1, k, 100 * k + f, 12 + (k == 0), 0.3, 0.2 * f))
    d = spark.createDataFrame(rows, "session_id long, track long, frame long, length long, world_x double, world_y double")
    a, b = (0.0, -20.0, 8.0), (0.0, 20.0, 8.0)
    seen = lambda c: d.withColumns({"world_x": c[0] + (F.col("world_x") - c[0]) * 8 / 7, "world_y": c[1] + (F.col("world_y") - c[1]) * 8 / 7})  # noqa: E731  a ball at 1 m
    got = TR.match_tracks(seen(a), seen(b), a, b).select("track_a", "track_b").distinct().collect()
    assert {tuple(r) for r in got} == {(k, k) for k in range(60)}


def test_static_cells_decay_by_frame(spark):
    """Against one pass in order, over several blocks; both candidates of a frame count before either is judged."""
    from arcline.operators.smooth import drop_static

    r = random.Random(4)
    rows = [(1, "cam66", f, k, 100.0 + r.random(), 50.0) for f in sorted(r.sample(range(9000), 900)) for k in range(r.randint(1, 2))]
    got = {(x["frame"], x["rank"]): x["heat"] for x in drop_static(spark.createDataFrame(rows, "session_id long, camera string, frame long, rank long, pixel_x double, pixel_y double")).collect()}
    heat, last, want = 0.0, None, {}
    for f in sorted({x[2] for x in rows}):
        n = [x for x in rows if x[2] == f]
        heat = heat * 0.98 ** (f - last if last is not None else 0) + len(n)
        last = f
        want.update({(f, x[3]): heat for x in n})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_package_can_be_shipped(spark):
    import zipfile

    from arcline.session import ship

    ship(spark)
    name = [p for p in spark.sparkContext._python_includes if p.endswith("arcline.zip")]
    assert name and "arcline/operators/fold.py" in zipfile.ZipFile(f"{spark.sparkContext._jvm.org.apache.spark.SparkFiles.getRootDirectory()}/{name[0]}").namelist()


def test_image_peaks_share_one_cooldown(spark):
    """A peak of the second camera three frames after one of the first is none, in any blocks; alone it is one."""
    top = lambda f, at: 600.0 - 12 * abs(f - at)
    rows = [(1, "cam66", f, top(f, 6), 0.0, -3.0) for f in range(1, 16)] + [(s, "cam68", f, top(f, 9), 0.0, 3.0) for s in (1, 2) for f in range(1, 16)]
    df = spark.createDataFrame(rows, "session_id long, camera string, frame long, pixel_y double, world_x double, world_y double")
    for block in (4, 65536):
        was, ordered.BLOCK = ordered.BLOCK, block
        try:
            got = {(r.session_id, r.camera, r.frame) for r in R.single_camera_bounces(df).collect()}
        finally:
            ordered.BLOCK = was
        assert got == {(1, "cam66", 6), (2, "cam68", 9)}
