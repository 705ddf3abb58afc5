"""Live rules: a stream in any number of files equals one pass over the rows; late rows, timers and restarts."""

import json
import os
from collections import namedtuple

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.plans import live as PL
from arcline.streaming import inorder as I
from arcline.streaming import reports as RP
from arcline.streaming import rules as S
from arcline.streaming import tracker as TK
from tests.conftest import SF

KEYS = ["session_id"]


def rows_of(df, *order):
    kind = namedtuple("Row", df.columns)
    return [kind(*r) for r in df.orderBy(*order).collect()]


def passed(rule, rows, **kw):
    names = T.StructType.fromDDL(rule.schema).names
    kind = namedtuple("Row", names)
    return [kind(*t) for t in S.one_pass(rule, rows, **kw)]


def same(got, want, names):
    key = lambda r: json.dumps([round(v, 9) if isinstance(v, float) else v for v in r])
    assert sorted(key([getattr(r, n) for n in names]) for r in got) == sorted(key([getattr(r, n) for n in names]) for r in want)


@pytest.mark.parametrize("files", [1, 3, 6])
def test_chain_in_any_cut(spark, files):
    """Smoothing, crossings, landings and verdicts, with a judge that rejects some."""
    p = PL.ball_rows(spark, SF).where("session_id = 0 and frame < 500")
    chain = I.in_order(I.in_order(I.replayed(p, "t", files), KEYS, S.motion()), KEYS, S.landings(cooldown=0.05), None)
    judge = S.acceptance(context_s=0.9)
    got = I.drained(I.in_order(chain, KEYS, judge, None), "chain").collect()
    steps = passed(S.motion(), rows_of(p, "frame"))
    steps = passed(S.landings(cooldown=0.05), steps, at=lambda r: r.seen)
    want = passed(judge, steps, at=lambda r: r.seen)
    names = T.StructType.fromDDL(judge.schema).names
    assert len({r.verdict for r in want}) > 2
    same(got, want, names)


@pytest.mark.parametrize("files", [1, 5])
def test_fusion_in_any_cut(spark, files):
    d = PL.camera_rows(spark, SF).where("session_id = 1").withColumn("t", F.col("frame") / 25)
    got = I.drained(I.in_order(PL.fusion_frames(I.replayed(d, "t", files)), KEYS, S.fusion(), None), "fused").collect()
    per = {}
    for r in rows_of(d, "frame", "side"):
        per.setdefault(r.frame, {})[r.side] = r
    kind = namedtuple("Row", "frame t a_x a_y a_py a_conf b_x b_y b_py b_conf x y z ray_dist")
    three = {r.frame: r for r in PL.triangulated(spark.createDataFrame([(f, *[getattr(c[s], n) for s in "ab" for n in ("world_x", "world_y")]) for f, c in per.items() if len(c) == 2],
                                                 "frame long, a_x double, a_y double, b_x double, b_y double"), "a", "b", PL.CAM_A, PL.CAM_B).collect()}
    rows = []
    for f in sorted(per):
        c = {s: [getattr(per[f][s], n) for n in ("world_x", "world_y", "pixel_y", "blob_sum")] if s in per[f] else [None] * 4 for s in "ab"}
        p = three.get(f)
        rows.append(kind(f, f / 25, *c["a"], *c["b"], *([p.x, p.y, p.z, p.ray_dist] if p else [None] * 4)))
    want = passed(S.fusion(), rows)
    assert {r.kind for r in want} == {"mode", "landing", "rally"}
    same(got, want, T.StructType.fromDDL(S.fusion().schema).names)


def frame(f, a=None, b=None, p=None, ray=None):
    kind = namedtuple("Row", "frame t a_x a_y a_py a_conf b_x b_y b_py b_conf x y z ray_dist")
    return kind(f, f / 25, *(a or [None] * 4), *(b or [None] * 4), *(p or [None] * 3), ray)


def test_fusion_modes_and_resets():
    both = ([0.0, -1.0, 500.0, 0.4], [0.1, -1.0, 400.0, 0.9])
    rule = S.fusion()
    state = json.loads(json.dumps(rule.init))
    modes = [rule.step(state, r)[0][2:4] for r in (frame(1, *both, p=[0, -1, 1.0], ray=0.5), frame(2, *both, p=[0, -1, 1.0], ray=3.0), frame(3, b=both[1]), frame(4, *both, p=[0, -1, 0.9], ray=0.1))]
    assert modes == [("3d", None), ("single_cam", "cam68"), ("single_cam", "cam68"), ("3d", None)]
    assert len(state["w"]) == 1 and len(state["a"]) == 3
    rule.step(state, frame(15, a=both[0]))
    assert len(state["a"]) == 1 and state["w"] == []
    rule.step(state, frame(16, a=[0.0, -1.0, 900.0, 0.4]))
    assert len(state["a"]) == 1  # a jump of the image row is no ball


def test_one_cooldown_for_both_cameras():
    """A peak of camera b right after one of camera a is none; the same peak alone is one."""

    def landings(only_b):
        rule = S.fusion()
        state = json.loads(json.dumps(rule.init))
        state["r"]["mode"], state["r"]["rally"] = "rally", {"f": 0, "t": 0.0, "n": 1, "b": 0, "server": "", "attempt": 1, "touch": False, "await": False, "last": "", "run": 0, "side": ""}
        state["r"]["t"], out = 0.0, []
        for f in range(1, 18):
            y = lambda top: 600.0 - 12 * abs(f - top)
            if f <= 8:
                r = frame(f, a=None if only_b else [0.0, -3.0, y(6), 0.9], b=[0.0, 3.0, y(9), 0.1])
            else:
                r = frame(f, b=[0.0, 3.0, y(9), 0.1])
            out += [(x[1], x[3]) for x in rule.step(state, r) if x[0] == "landing"]
        return out

    assert landings(False) == [(6, "cam66")] and landings(True) == [(9, "cam68")]


def test_rejected_landing_gives_its_crossing_back():
    kind = namedtuple("Row", "kind seen frame t x y z speed direction in_court confidence source")
    cross = lambda t, v: kind("crossing", t, int(t * 25), t, 0.0, 0.0, 1.0, v, "near_to_far", None, None, None)
    land = lambda t, x, y=5.0: kind("landing", t, int(t * 25), t, x, y, 0.1, None, None, True, 0.9, "3d")
    rows = [cross(1.0, 80), land(1.5, 0.0), cross(1.7, 90), land(1.8, 0.5), land(1.85, 3.0), land(9.0, 0.0)]
    got = [(r.t, r.verdict, r.speed) for r in passed(S.acceptance(), rows, at=lambda r: r.seen) if r.kind == "landing"]
    assert got == [(1.5, "accepted", 80), (1.8, "duplicate", 90), (1.85, "accepted", 90), (9.0, "accepted", None)]
    late = [(r.t, r.verdict) for r in passed(S.acceptance(context_s=3.0), [land(0.5, 0.0), *rows], at=lambda r: r.seen) if r.kind == "landing"]
    assert late[0] == (0.5, "f4_no_net_crossing") and late[-1] == (9.0, "f4_stale_net_crossing")


def test_late_rows_are_counted_and_open_things_end_by_timer(spark):
    src = f"/tmp/spark-late-{os.getpid()}-{id(spark)}"
    fields = "session_id long, frame long, t double, y double, bounce boolean"

    def put(rows):
        spark.createDataFrame(rows, fields).withColumn(I.AT, F.timestamp_micros(F.round((F.col("t") + I.DAY) * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(src)

    put([(1, 1, 10.0, -1.0, None), (1, 2, 10.5, 1.0, True)])
    put([(1, 3, 11.0, -1.0, None), (2, 1, 40.0, 1.0, None)])
    put([(2, 2, 41.0, 1.0, None)])
    put([(1, 4, 12.0, 1.0, None)])  # behind the watermark by now
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    late = []
    got = I.drained(I.in_order(stream, KEYS, S.crossing_rallies()), "late", late).collect()
    assert [(r.session_id, r.rally, r.start_frame, r.end_frame, r.strokes, r.bounces) for r in got] == [(1, 1, 2, 3, 2, 1)] and late == [1]


def test_reports_survive_a_restart(spark):
    """Stopped after two files, the last batch's commit lost: it runs again and the reports are the same."""
    src, base = (f"/tmp/spark-{n}-{os.getpid()}-{id(spark)}" for n in ("rallies", "reports"))
    fields = "session_id long, rally long, start_t double, end_t double, strokes long, bounces long"
    rows = [(s, k, 10.0 * k, 10.0 * k + s + k, k, s) for k in range(1, 10) for s in (1, 2)]
    cut = [rows[:5], rows[5:9], rows[9:10], rows[10:]]

    def run():
        return RP.reports(spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(src), 3, base)

    for part in cut[:2]:
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(src)
    run()
    os.remove(f"{base}/state/commits/1")
    if os.path.exists(f"{base}/state/commits/.1.crc"):
        os.remove(f"{base}/state/commits/.1.crc")
    for part in cut[2:]:
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(src)
    got = sorted(map(tuple, run().collect()))
    want = []
    for s in (1, 2):
        for n in (3, 6, 9):
            ks = range(1, n + 1)
            want.append((s, n, sum(ks), s * n, float(sum(s + k for k in ks))))
    assert got == sorted(want)


def test_full_history_keeps_its_threshold_fresh():
    """Against sorting the history anew for each pair."""
    import random

    r, kind = random.Random(2), namedtuple("Row", "frame a_t a_pixel_x a_pixel_y b_pixel_x b_pixel_y a_blob_sum b_blob_sum")
    rows = [kind(i, i / 25, r.randint(0, 1), 0, 0, 0, r.random(), r.random()) for i in range(400)]
    got = [(t[0], t[3]) for t in S.one_pass(S.gate(size=60, every=20), rows, at=lambda x: x.a_t)]
    hist, quad, limit, want = [], None, 0.0, []
    for x in rows:
        q = list(x[2:6])
        if q == quad:
            continue
        c = (x.a_blob_sum + x.b_blob_sum) / 2
        hist = [*hist, c][-60:]
        if len(hist) >= 20 and len(hist) % 20 == 0:
            limit = sorted(hist)[int(len(hist) * 0.2)]
        if c >= limit:
            quad = q
            want.append((x.frame, limit))
    assert got == want


def whole_buffer(rows, block, max_px, gap, min_rows, min_common, max_ray):
    """The rule as one would write it down: at each block's end everything received is tracked and matched anew."""
    from statistics import median

    frames, out, seen, hits = sorted({r.frame for r in rows}), [], set(), set()
    ends = [f for f, n in zip(frames, [*frames[1:], None]) if n is None or n // block > f // block]
    for end in ends:
        tracks = {}
        for side in "ab":
            live = []
            for f in [f for f in frames if f <= end]:
                here = [(r.pixel_x, r.pixel_y, r.world_x, r.world_y) for r in rows if r.frame == f and r.side == side]
                if not here:
                    continue
                live = sorted([t for t in live if f - t[-1][0] <= gap], key=lambda t: -len(t))
                left = list(enumerate(here))
                for t in live:
                    gx, gy = t[-1][1], t[-1][2]
                    if len(t) > 1:
                        k = (f - t[-1][0]) / (t[-1][0] - t[-2][0])
                        gx, gy = gx + k * (t[-1][1] - t[-2][1]), gy + k * (t[-1][2] - t[-2][2])
                    if left:
                        d, i, b = min((((b[0] - gx) ** 2 + (b[1] - gy) ** 2) ** 0.5, i, b) for i, b in left)
                        if d < max_px:
                            left.remove((i, b))
                            t.append((f, *b))
                for i, b in left:
                    live.append([(f, *b)])
                    tracks[f"{side}{f}-{i}"] = live[-1]
        best = None
        for na, ta in tracks.items():
            for nb, tb in tracks.items():
                if na[0] != "a" or nb[0] != "b" or min(len(ta), len(tb)) < min_rows:
                    continue
                pb = {p[0]: p[3:] for p in tb}
                pts = []
                for p in ta:
                    if p[0] in pb:
                        xyz, ray = TK.crossing_point(p[3:], pb[p[0]], PL.CAM_A, PL.CAM_B)
                        pts.append((p[0], *xyz, ray))
                if len(pts) < min_common or median(p[4] for p in pts) >= max_ray or sum(0.05 <= p[3] <= 5 for p in pts) * 2 <= len(pts):
                    continue
                if best is None or (-len(pts), na, nb) < best[0]:
                    best = ((-len(pts), na, nb), pts)
        if best:
            out += [("point", *p) for p in best[1] if p[0] not in seen]
            seen |= {p[0] for p in best[1]}
            lands = [h for h in TK.landings_of(best[1]) if h[0] not in hits]
            out += [("landing", *h, None) for h in lands]
            hits |= {h[0] for h in lands}
    return out


@pytest.mark.parametrize("files", [5])
def test_block_tracks_equal_the_whole_buffer(spark, files):
    """Five blocks and more; the state at the end holds what is open only."""
    cut = {"block": 60, "max_px": 120.0, "gap": 3, "min_rows": 5, "min_common": 4, "max_ray": 1.0}
    rows = PL.blob_rows(spark, SF).where("session_id = 0 and frame < 400")
    rule = TK.block_tracks(PL.CAM_A, PL.CAM_B, **cut)
    plain = rows_of(rows, "frame", "side", "rank")
    want = whole_buffer(plain, **cut)
    assert len(want) > 20
    got = I.drained(I.in_order(I.replayed(rows, "t", files), KEYS, rule), "tracks").collect()
    kind = namedtuple("Row", T.StructType.fromDDL(rule.schema).names)
    same(got, [kind(*t) for t in want], kind._fields)
    state, sizes = json.loads(json.dumps(rule.init)), []
    for r in plain:
        rule.step(state, r)
        sizes.append(len(json.dumps(state)))
    assert max(sizes[len(sizes) // 2:]) < 2 * max(sizes[: len(sizes) // 2])


def test_lines_of_sight_meet_as_in_columns(spark):
    d = [(1.0, 2.0, 1.5, 1.8), (0.0, -9.0, 3.0, 9.0), (4.0, 11.0, -4.0, -11.0)]
    df = spark.createDataFrame(d, "a_x double, a_y double, b_x double, b_y double")
    for r in PL.triangulated(df.select(*[F.col(c).alias(c) for c in df.columns], *[F.col(c).alias(f"k_{c}") for c in df.columns]), "a", "b", PL.CAM_A, PL.CAM_B).collect():
        p, ray = TK.crossing_point((r.k_a_x, r.k_a_y), (r.k_b_x, r.k_b_y), PL.CAM_A, PL.CAM_B)
        assert max(abs(x - y) for x, y in zip([*p, ray], [r.x, r.y, r.z, r.ray_dist])) < 1e-9
