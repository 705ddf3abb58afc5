"""The same answers when every session spans many small blocks."""

import pytest

from arcline.operators import ordered
from arcline.plans.registry import ORACLES, QUERIES
from tests.check import differ
from tests.conftest import SF

NAMES = ["w1_gap_segments", "w2_segment_rallies", "w6_frame_speeds", "w11_count_shots", "w4_w5_clean_detections", "w26_net_crossings", "j3_interpolating_asof",
         "j14_match_events_by_truth", "j18_landing_camera_asof", "w32_savitzky_golay", "w33_median_filter", "w34_exponential_mean", "w43_fill_quadratic",
         "w13_peak_bounces", "w19_hybrid_bounces", "w30_shots", "x6_crossing_rallies", "w47_track_matrix", "w49_rally_features", "w50_smooth_labels"]


@pytest.mark.parametrize("name", NAMES)
def test_small_blocks(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "BLOCK", 200)
    assert differ(QUERIES[name](spark, SF), con, ORACLES[name]) is None
