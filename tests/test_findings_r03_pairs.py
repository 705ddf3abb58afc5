"""Third round, F15, F20 and F28: gates of candidate pairs."""

from arcline.plans.joins import pairs
from tests.conftest import SF


def test_gate_of_candidate_pairs_does_not_repeat_the_triangulation(spark):
    plan = pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all(len(line) < 1000 for line in joins)
