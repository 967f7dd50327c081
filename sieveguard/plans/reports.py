"""Reports over the decision table: its current rows, filtered, then summed up or listed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.operators import aggregates as A
from sieveguard.operators.topk import recent_events
from sieveguard.sources.sinks import current_events, read_events

# Rows of several systems in one run stay apart.
SYSTEM_KEY = ("run_id", "event_id", "system_name")


def table_rows(spark: SparkSession, path: str, run_id: str | None = None,
               system: str | None = None, key: Sequence[str] = SYSTEM_KEY) -> DataFrame:
    """Current rows of a run and system.

    Both are part of the key and leading folders of the table: only their folders are read.
    """
    return current_events(spark, path, key, run_id, system)


def summary_report(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Counts, quality, escalation and throughput per run and system, with the number of rows
    that are labelled anomalies (``ground_truth_count``)."""
    total = A.run_summary(table_rows(spark, path, run_id))
    out = A.throughput(A.escalation_rate(A.detection_metrics(total)))
    return out.withColumn("ground_truth_count", F.col("tp") + F.col("fn"))


def series_report(spark: SparkSession, path: str, run_id: str, system: str,
                  window: str = "24h") -> DataFrame:
    return A.event_series(table_rows(spark, path, run_id, system), run_id, system, window,
                          raw=read_events(spark, path))


def recent_report(spark: SparkSession, path: str, run_id: str, system: str,
                  limit: int = 50) -> DataFrame:
    return recent_events(table_rows(spark, path, run_id, system), limit)


def status_report(spark: SparkSession, path: str, runs: DataFrame,
                  systems: Sequence[str] = (S.MODE_FAST, S.MODE_SELECTIVE)) -> DataFrame:
    """State of every registered run, with or without rows."""
    return A.run_status(A.run_summary(table_rows(spark, path)), runs, systems)
