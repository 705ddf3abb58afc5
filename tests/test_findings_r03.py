"""Cases of the third round's findings that the small tables do not hold."""

import duckdb
import pytest

from arcline.plans.registry import ORACLES, QUERIES
from tests.check import connect, differ
from tests.conftest import SF


@pytest.fixture(scope="module")
def events_of(tmp_path_factory):
    """A folder like the smallest tables, with those events of sf0.1 that a condition names."""

    def make(where):
        path = tmp_path_factory.mktemp("tables")
        for name in ("nation", "customer", "region", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            (path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
        duckdb.connect().execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE {where}) TO '{path}/events.parquet' (FORMAT parquet)")
        return str(path)

    return make


def test_places_above_the_image(spark, events_of):
    sf = events_of("event_id // 512 IN (119, 120)")
    assert differ(QUERIES["a23_static_clusters"](spark, sf), connect(sf), ORACLES["a23_static_clusters"]) is None


def test_robust_fits_by_chunks(spark, monkeypatch):
    from arcline.operators import fit

    rows = [(g, i, float(i) / 25, 0.1 * i, -10 + 0.2 * i + (5.0 if i % 9 == g else 0.0), 1 + 0.3 * i - 0.003 * i * i + (3.0 if i % 7 == 2 else 0.0), 0.5) for g in range(3) for i in range(90 if g else 3)]
    points = spark.createDataFrame(rows, "g long, frame long, t double, x double, y double, z double, ray_dist double")
    got = []
    for chunk in (16, 1024):
        monkeypatch.setattr(fit, "CHUNK", chunk)
        got.append(sorted((r["g"], r["frame"]) for r in fit.ransac_fits(points, ["g"], 40).collect()))
    assert got[0] == got[1] and 0 < len(got[0]) < len(rows)
    assert [x for x in got[0] if x[0] == 0] == [(0, 0), (0, 1), (0, 2)]  # too few rows to draw from: all stay


def test_best_split_reads_settled_inputs(spark):
    from arcline.operators import bounce, fit

    rows = [(1, 1, i, i / 25, 0.1 * i, 0.2 * i - 8, abs(i % 20 - 10) / 10, 0.5) for i in range(60)]
    rally = spark.createDataFrame(rows, "session_id long, rally long, frame long, t double, x double, y double, z double, ray_dist double")
    out = fit.best_split(rally, bounce.robust_minima(rally))
    # each branch planned the prefix sums and fits anew: the plan doubled with every step that followed
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
    assert out.count() == 1


def test_prominence_takes_many_blocks_at_a_time(spark, monkeypatch):
    from arcline.operators import peaks

    rows = [(s, i, float((i * 7 + s) % 11)) for s in range(40) for i in range(12)]
    t = spark.createDataFrame(rows, "s long, frame long, v double")
    want = sorted((s, k) for s in range(40) for k in peaks.peak_positions([v for q, _, v in rows if q == s], 2, 3.0))
    for size in (50_000, 100):
        monkeypatch.setattr(peaks, "ROWS", size)
        assert sorted((r["s"], r["idx"]) for r in peaks.find_peaks(t, ["s"], "v", 2, 3.0).collect()) == want


def test_features_hold_no_window_lists(spark):
    from arcline.plans.tables import features

    # each row carried six lists of its neighbours from the windows to the spectra
    assert "collect_list" not in features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_stream_of_a_folder_of_files(spark, events_of):
    from pathlib import Path

    sf = events_of("event_id < 1024")
    con = connect(sf)
    want = con.execute(ORACLES["x1_stream_pairing"]).fetchall()
    one = Path(sf, "events.parquet")
    rows = one.rename(Path(sf, "all.parquet"))
    one.mkdir()
    for i in range(3):
        duckdb.connect().execute(f"COPY (SELECT * FROM '{rows}' WHERE event_id % 3 = {i}) TO '{one}/part-{i}.parquet' (FORMAT parquet)")
    got = QUERIES["x1_stream_pairing"](spark, sf)  # the file's name was asked for, so a folder's files were not seen
    assert want and sorted(map(tuple, got.select("session_id", "frame", "x", "z").collect())) == sorted(want)


def test_offsets_measured_in_blocks(spark, monkeypatch):
    from arcline.operators import align
    from arcline.plans.fixtures import CAM_A, CAM_B, table

    monkeypatch.setattr(align, "LAG_BLOCK", 100)
    a, b, cams = (table(spark, SF, t) for t in ("det66", "det68", "cams"))
    shifts = [-0.52, 0.0, 0.013]
    asked = a.select("session_id").distinct().crossJoin(spark.createDataFrame([(s,) for s in shifts], "dt double"))
    got, want = (sorted((r["session_id"], r["dt"], round(r["cost"], 9)) for r in t.collect()) for t in (
        align.measured_offsets(a, b, cams, CAM_A, CAM_B, asked, 1.0), align.sweep_time_offsets(a, b, cams, CAM_A, CAM_B, shifts)))
    assert len(got) == 6 and got == [pytest.approx(w, abs=2e-9) for w in want]
