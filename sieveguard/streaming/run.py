"""Streaming runs: score once per micro-batch, write events, alerts and open cases."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveguard.functions.columns import alerts, uncertain_branch
from sieveguard.sources.readings import BATCH_FILES
from sieveguard.sources.commits import COMMIT, CommittedTable
from sieveguard.sources.sinks import AlertList, append_events, event_rows


FILE_ROWS = 125_000   # of a micro-batch in one file of a table, about


def fan_out(path: str, branches: Callable[[DataFrame, int], None] | None = None,
            writer: str = "stream", alert_cap: int | None = None
            ) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: committed tables ``events``, ``alerts`` and ``uncertain`` under
    ``path``, and with ``alert_cap`` the ``alert_list`` of the newest alerts of each run.

    The batch is kept while its branches are written, so it is scored once. Every table gets as
    many files as its rows fill, however many tasks the state of the stream has. A retried batch
    writes only the tables it had not committed before, so several runs and modes share one table
    and readers of any branch see every batch once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            # The count computes the batch in the tasks of its state; the writers read what is kept.
            rows = batch.coalesce(max(1, -(-batch.count() // FILE_ROWS)))
            append_events(event_rows(rows), batch_id, f"{path}/events", writer)
            CommittedTable(spark, f"{path}/alerts").append(
                alerts(rows).select("run_id", "event_id", "processed_at_epoch_ms", "is_anomaly",
                                    F.to_json(F.struct(*batch.columns)).alias("alert")),
                writer, batch_id)
            CommittedTable(spark, f"{path}/uncertain").append(
                uncertain_branch(rows), writer, batch_id)
            if alert_cap is not None:
                AlertList(spark, f"{path}/alert_list", alert_cap).update(rows, writer, batch_id)
            if branches is not None:
                branches(batch, batch_id)
        finally:
            batch.unpersist()
    return write


def writer_name(checkpoint: str) -> str:
    """A stream's name in its tables: a hash of its checkpoint's path."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def run_external(spark: SparkSession, path: str, checkpoint: str,
                 decide: Callable[[DataFrame], DataFrame],
                 trigger: dict | None = None) -> StreamingQuery:
    """Decide the open cases under ``path`` in a stream of its own, beside the main one.

    The main stream only commits its ``uncertain`` table; a slow or hanging model delays nothing
    there. This stream's input is the log of those commits, one small file each: a batch is handed
    over when it is whole, and once, however often the main stream tries it. ``decide`` gives
    decision records, for example :func:`~sieveguard.detectors.external.external_decision`; they
    are added to ``events``, and a retry here adds none twice.
    """
    cases = CommittedTable(spark, f"{path}/uncertain")
    cases.files.make(cases.log)
    named = (spark.readStream.format("text").option("pathGlobFilter", f"{COMMIT}*.json")
             .option("wholetext", True).option("maxFilesPerTrigger", BATCH_FILES)
             .load(cases.log))
    writer = writer_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = [json.loads(r["value"]) for r in batch.collect()]  # at most BATCH_FILES
        folders = [p["folder"] for e in entries for p in e["parts"]]
        if folders:
            rows = cases.read_folders(folders, entries[-1]["schema"]).drop(
                "written_at_epoch_ms", "writer", "batch")
            append_events(event_rows(decide(rows)), batch_id, f"{path}/events", writer)

    return (named.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(write).start())


def run_stream(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
               branches: Callable[[DataFrame, int], None] | None = None,
               alert_cap: int | None = None) -> StreamingQuery:
    """Start writing a stream of decision records (see ``plans.flow.decide_records``).

    ``trigger`` defaults to one second, the flush interval of the decision table.
    Restarting with the same checkpoint continues where the last run stopped; the checkpoint's
    path names the writer.
    """
    writer = writer_name(checkpoint)
    return (records.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"}))
            .foreachBatch(fan_out(path, branches, writer, alert_cap)).start())


def alert_console(records: DataFrame, checkpoint: str, sink: str = "console",
                  name: str = "alerts") -> StreamingQuery:
    """Print alerts as they come (or keep them in memory, to look at in a session)."""
    return (alerts(records).writeStream.format(sink).queryName(name).option("truncate", False)
            .option("checkpointLocation", checkpoint).start())


def stream_dedup(records: DataFrame, ts: str, delay: str,
                 key: Sequence[str] = ("run_id", "event_id", "engine")) -> DataFrame:
    """Drop repeated rows inside a time bound, for readers that cannot take the last row
    at query time."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def stream_series(records: DataFrame, bucket: str = "60 seconds", delay: str = "5 minutes"
                  ) -> DataFrame:
    """Time-bucket counts of a stream by processing time."""
    timed = records.withColumn("_at", F.timestamp_millis("processed_at_epoch_ms"))
    return timed.withWatermark("_at", delay).groupBy(
        "run_id", "system_name", F.window("_at", bucket).alias("_w")).agg(
        F.count("*").alias("readings"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
        F.count_if(F.col("escalated").cast("int") == 1).alias("escalated"),
    ).select("run_id", "system_name",
             F.unix_millis(F.col("_w.start")).alias("bucket_ms"), "readings", "anomalies",
             "escalated")


MINUTE_MS = 60_000
SERIES_COUNTS = ["readings", "anomalies", "escalated"]


def series_table(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, ("run_id", "system_name"))


def run_series(records: DataFrame, path: str, checkpoint: str, horizon: str = "1 day",
               key: Sequence[str] = ("run_id", "event_id", "engine"),
               trigger: dict | None = None) -> StreamingQuery:
    """Keep counts per minute of processing time, only ever adding to them.

    Each micro-batch commits what it adds to its minutes, so a late row corrects its minute
    whenever it comes, and no count waits for a watermark. Rows repeated within ``horizon`` of
    each other count once; a row later than that cannot be told from a repetition and is left out.
    """
    timed = records.withColumn("_at", F.timestamp_millis("processed_at_epoch_ms"))
    once = timed.withWatermark("_at", horizon).dropDuplicatesWithinWatermark(list(key))
    writer = writer_name(checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        minute = F.floor(F.col("processed_at_epoch_ms") / MINUTE_MS) * MINUTE_MS
        counts = batch.groupBy("run_id", "system_name", minute.alias("bucket_ms")).agg(
            F.count("*").alias("readings"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
            F.count_if(F.col("escalated").cast("int") == 1).alias("escalated"))
        series_table(batch.sparkSession, path).append(counts, writer, batch_id)

    return (once.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(add).start())


def read_series(spark: SparkSession, path: str, bucket_ms: int = MINUTE_MS, **values: str
                ) -> DataFrame:
    """Counts per run, system and bucket of whole minutes (of one ``run_id``, ``system_name``)."""
    if bucket_ms % MINUTE_MS:
        raise ValueError("buckets are whole minutes")
    start = (F.floor(F.col("bucket_ms") / bucket_ms) * bucket_ms).alias("bucket_ms")
    return series_table(spark, path).read(**values).groupBy("run_id", "system_name", start).agg(
        *[F.sum(c).alias(c) for c in SERIES_COUNTS])
