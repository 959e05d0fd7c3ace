import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docketry.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[8]", partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A one-partition DataFrame of literal rows."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
