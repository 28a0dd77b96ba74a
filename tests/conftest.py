import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from studyloom.session import local_session

    s = local_session("8", "studyloom-tests", 8)
    yield s
    s.stop()


@pytest.fixture
def many_blocks(spark):
    """Keep small range partitions apart, so block edges are crossed on small data."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)
