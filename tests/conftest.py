import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from peerscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, driver_memory="8g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate Column expressions on a single row."""

    def run(*columns, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
