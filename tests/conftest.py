import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from papyra.session import get_spark
    s = get_spark("local[4]", app="papyra-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from papyra.sources.fixtures import register
    return register(spark, SF_SMALL)
