"""Every query with an SQL twin, on the smallest tables."""

import pytest

from arcline.plans.registry import ORACLES, QUERIES
from tests.check import differ
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert differ(QUERIES[name](spark, SF), con, ORACLES[name]) is None
