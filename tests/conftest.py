import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stayscope.session import local_session, release_scratch

    session = local_session("8", partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    from stayscope.plans.workforce import profile
    from stayscope.session import materialise

    return materialise(profile(spark, TINY), "people")


@pytest.fixture(scope="session")
def raw(spark):
    from stayscope.plans.workforce import profile_raw
    from stayscope.session import materialise

    return materialise(profile_raw(spark, TINY), "raw")
