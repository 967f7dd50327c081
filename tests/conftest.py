import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


READING_SCHEMA = ("run_id string, event_id string, seq long, ts timestamp_ntz, moteid int,"
                  " temperature double, humidity double, light double, voltage double")


def make_readings(spark, rows):
    """(mote, second, temperature, voltage) tuples as readings; seq is the list position."""
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    data = [("r", f"r:{i}", i, start + dt.timedelta(seconds=s), m, t, 40.0, 100.0, v)
            for i, (m, s, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, READING_SCHEMA)
