import pytest

from arcline.plans import load_all
from arcline.session import local_session

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", partitions=4)


@pytest.fixture(scope="session")
def con():
    from tests.check import connect

    return connect(SF)
