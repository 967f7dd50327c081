"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_queries import TABLES, table

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(entry_module.oracle_sql())
# One of each kind here; tools/check_queries.py runs them all.
CHECKED = ["flagship", "dual_window_features", "dual_window_features_busy_sensors", "roc_auc",
           "latest_by_key", "escalation_sweep", "inject_anomalies", "event_series_24h",
           "recent_events", "stream_score"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(NAMES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_sql_runs(duck, name):
    assert duck.sql(entry_module.oracle_sql()[name]).fetchall() is not None


def test_entry(spark):
    df = entry_module.entry(spark)
    rows = {r["system_name"]: r for r in df.collect()}
    assert (rows["fast"]["total"], rows["fast"]["tp"], rows["fast"]["anomalies"]) == (1000, 25, 60)
    assert (rows["selective"]["escalated"], rows["selective"]["tp"]) == (123, 35)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SMALL)
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(
        list(rel.columns), rel.fetchall())
