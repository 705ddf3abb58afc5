"""Headline timings: one JSON line. Data: $BENCH_SF_DIR, cores: $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from arcline.operators import bounce, motion, smooth  # noqa: E402
from arcline.operators.ordered import segments  # noqa: E402
from arcline.plans import load_all  # noqa: E402
from arcline.plans.fixtures import table  # noqa: E402
from arcline.plans.motion import rallies, rally_summary  # noqa: E402
from arcline.plans.registry import QUERIES  # noqa: E402
from arcline.session import local_session  # noqa: E402

BIG = "points_big"
XYZ = ("x", "y", "z")


def cases():
    """The larger sensor table comes from lineitem; the others are registered queries."""
    keys = ["session_id"]
    yield "scan_points", lambda s, d: table(s, d, BIG)
    yield "gap_segments", lambda s, d: segments(table(s, d, BIG), keys, "frame", 3).groupBy("session_id", "seg").agg(F.count("*").alias("n"))
    yield "segment_rallies", lambda s, d: rallies(s, d, BIG)
    yield "frame_speeds", lambda s, d: motion.frame_speeds(rallies(s, d, BIG))
    yield "net_crossings", lambda s, d: motion.net_crossings(table(s, d, BIG))
    yield "savgol_3d", lambda s, d: smooth.sg_smooth(table(s, d, BIG), 11, 3, XYZ, keys, gap=8, floor_cols=("z",))
    yield "peak_bounces", lambda s, d: bounce.peak_bounces(table(s, d, BIG))
    yield "rally_summary", lambda s, d: rally_summary(s, d, BIG)
    for name in ("j1_two_camera_join", "m2_triangulate_bounded", "j9_best_candidate_pair", "j14_match_events_by_truth", "j3_interpolating_asof",
                 "a16_tracking_scores", "w33_median_filter", "w35_kalman", "w19_hybrid_bounces", "x6_crossing_rallies", "x7_points_played"):
        yield name, QUERIES[name]


def main() -> None:
    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    table(spark, sf_dir, BIG).agg(F.count("*")).collect()  # start the executors
    took = {}
    for name, fn in cases():
        t = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
