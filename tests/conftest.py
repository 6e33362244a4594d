"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from digestmill.session import local_session

    session = local_session(cores=8, shuffle_partitions=4, app="digestmill-tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a Column function for one row of named values."""

    def run(column, schema: str = "", *values):
        frame = spark.createDataFrame([tuple(values)], schema) if schema else spark.range(1)
        return frame.select(column.alias("v")).collect()[0]["v"]

    return run
