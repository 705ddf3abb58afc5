"""Linked groups and static places."""

import random

from arcline.operators import evaluate as E
from arcline.operators.groups import linked_groups


def test_groups_of_long_chains(spark):
    r = random.Random(1)
    links = [(1, i, i + 1) for i in range(200) if i % 50 != 49] + [(2, 5, 3), (2, 3, 9), (2, 7, 7)]
    r.shuffle(links)
    got = {(x.k, x.node): x.label for x in linked_groups(spark.createDataFrame(links, "k long, a long, b long"), ["k"]).collect()}
    assert all(got[1, i] == i // 50 * 50 for i in range(200)) and {got[2, n] for n in (3, 5, 9)} == {3} and got[2, 7] == 7


def test_ball_on_a_corner_is_one_place(spark):
    """Forty frames around the corner of four cells: one place; a passing ball is none."""
    r = random.Random(2)
    rows = [(1, "cam66", f, 100 + r.choice([-4.0, 4.0]), 50 + r.choice([-4.0, 4.0])) for f in range(40)]
    rows += [(1, "cam66", f, 300.0 + 30 * f, 400.0) for f in range(40)] + [(1, "cam68", f, 260.0, 260.0) for f in range(30)]
    got = E.static_clusters(spark.createDataFrame(rows, "session_id long, camera string, frame long, pixel_x double, pixel_y double")).collect()
    assert sorted((x.camera, x.cells, x.frames) for x in got) == [("cam66", 4, 40), ("cam68", 1, 30)]
    place = next(x for x in got if x.camera == "cam66")
    assert abs(place.x - 100) < 4 and abs(place.y - 50) < 4
