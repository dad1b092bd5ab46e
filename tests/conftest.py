import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hoptrail.session import local_session  # noqa: E402

SF = os.environ.get("HOPTRAIL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def many_runs(spark):
    """Keeps small sorts in several partitions, so that series and ranks cross run borders."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)
