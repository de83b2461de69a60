import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import get_session
    s = get_session("local[4]", 4)
    yield s


@pytest.fixture(scope="session")
def raw_df(spark):
    """Build a raw (all-text) DataFrame from tuples in source order."""
    from tallyspark.schema import RAW_SCHEMA

    def make(rows):
        return spark.createDataFrame(rows, RAW_SCHEMA)
    return make
