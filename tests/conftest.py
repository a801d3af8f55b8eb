import os
import sys
from datetime import timedelta

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from fixtures import T0  # noqa: E402
from trailspark.schema import SILVER_COLUMNS, SILVER_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Silver events from short dicts: ``at`` is seconds after T0, ids count up."""

    def build(*rows):
        full = []
        for number, row in enumerate(rows):
            row = dict(row)
            row["ts"] = T0 + timedelta(seconds=row.pop("at", number))
            row.setdefault("event_id", number)
            row.setdefault("session_id", "s")
            row.setdefault("event_name", "PreToolUse")
            full.append(tuple(row.get(name) for name in SILVER_COLUMNS))
        return spark.createDataFrame(full, SILVER_SCHEMA)

    return build
