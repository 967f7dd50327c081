"""Writers: replay messages, decision table, alerts, run records, result files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.functions.columns import alerts
from sieveguard.operators.dedup import latest_by_key, top_per_group
from sieveguard.operators.ordering import ordered_sequence, split_order, take_first
from sieveguard.sources.commits import CommittedTable

ALERT_CAP = 2000


def stamp_replay(df: DataFrame, run_id: str, order: Sequence[str] = ("ts", "event_id"),
                 limit: int | None = None, now_ms: int | Column | None = None) -> DataFrame:
    """Replay messages: number rows from 1, name them ``run:n``, key by mote.

    ``now_ms`` is the send time (default: the time of the query).
    """
    wanted = [c for c in df.columns if c in S.READING.names or c in
              [split_order(o)[0] for o in order]]
    df = df.select(*wanted)
    chosen = df if limit is None else take_first(df, order, limit)
    numbered = ordered_sequence(chosen, order, start=1, name="n")
    if now_ms is None:
        now_ms = F.unix_millis(F.current_timestamp())
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    rows = numbered.withColumns({
        "run_id": F.lit(run_id),
        "event_id": F.concat(F.lit(f"{run_id}:"), F.col("n").cast("string")),
        "sent_at_epoch_ms": now.cast("long"),
    })
    body = [f.name for f in S.READING.fields if f.name in rows.columns]
    return rows.select("n", *body, F.col("moteid").cast("string").alias("key"),
                       F.to_json(F.struct(*body)).alias("value"))


# Producer settings of the replay topic.
PRODUCER = {"kafka.acks": "all", "kafka.compression.type": "lz4", "kafka.linger.ms": "5",
            "kafka.batch.size": "65536"}


def to_kafka(df: DataFrame, bootstrap: str, topic: str, checkpoint: str | None = None):
    """Write key and value to a topic (needs Spark's Kafka package)."""
    options = {"kafka.bootstrap.servers": bootstrap, "topic": topic, **PRODUCER}
    rows = df.select(F.col("key").cast("binary"), F.col("value").cast("binary"))
    if df.isStreaming:
        if checkpoint is None:
            raise ValueError("a streaming write needs a checkpoint folder")
        return rows.writeStream.format("kafka").options(**options).option(
            "checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def event_rows(df: DataFrame) -> DataFrame:
    """Decision records in the layout of the decision table."""
    stamp = F.substring(F.translate("timestamp", "T", " "), 1, 23)
    plain = F.concat(F.col("date"), F.lit(" "), F.col("time"))
    truth = F.col("ground_truth" if "ground_truth" in df.columns else "label")
    shown = df.withColumns({
        "timestamp": F.coalesce(stamp, plain),
        "ground_truth": truth,
        "uncertain": F.col("uncertain").cast("int"),
        "escalated": F.col("escalated").cast("int"),
        "anomaly_reasons": F.coalesce("anomaly_reasons", F.lit("")),
        "anomaly_type": F.coalesce("anomaly_type", F.lit("")),
    })
    return shown.select(*S.EVENT_COLUMNS)


EVENTS_BY = ("run_id", "system_name")


def event_table(spark: SparkSession, path: str) -> CommittedTable:
    """The decision table at ``path``, led by run and system."""
    return CommittedTable(spark, path, EVENTS_BY)


def append_events(batch: DataFrame, batch_id: int, path: str, writer: str = "batch") -> bool:
    """Add one micro-batch of one writer to the decision table.

    A batch that the same writer repeats is not written again (False is returned); other runs,
    modes and writers are not touched.
    """
    return event_table(batch.sparkSession, path).append(batch, writer, batch_id)


def read_events(spark: SparkSession, path: str, run_id: str | None = None,
                system: str | None = None) -> DataFrame:
    """All written rows (of a run, of a system), with time of writing, writer and batch number."""
    wanted = {"run_id": run_id, "system_name": system}
    return event_table(spark, path).read(**{k: v for k, v in wanted.items() if v is not None})


def current_events(spark: SparkSession, path: str, key: Sequence[str] = S.EVENT_KEY,
                   run_id: str | None = None, system: str | None = None) -> DataFrame:
    """The decision table as readers see it: the last inserted row per key.

    A writer's batches are later than its earlier ones, whatever its clock says. A system may be
    asked for only where it is part of the key.
    """
    if system is not None and "system_name" not in key:
        raise ValueError("rows of other systems decide which row is the last")
    return latest_by_key(read_events(spark, path, run_id, system), key, (
        "-written_at_epoch_ms", "-batch", "-processed_at_epoch_ms", "writer"))


def alert_rows(found: DataFrame) -> DataFrame:
    """Alerts as (run_id, event_id, processed_at_epoch_ms, alert as JSON)."""
    return found.select("run_id", "event_id", "processed_at_epoch_ms",
                        F.to_json(F.struct(*found.columns)).alias("alert"))


def capped_alerts(df: DataFrame, cap: int = ALERT_CAP) -> DataFrame:
    """The newest alerts of each run as JSON."""
    return alert_rows(top_per_group(alerts(df), ["run_id"], NEWEST, cap, unique="event_id"))


NEWEST = ("-processed_at_epoch_ms", "-event_id")


class AlertList:
    """The newest alerts of every run, kept up to date as batches come.

    A batch is merged with the list before it and cut to ``cap`` alerts a run in one pass: it costs
    its own alerts and one list, however many alerts a run has had. Every list is a committed version
    named by writer and batch. A batch not after the last one changes nothing; versions before
    the last two are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int = ALERT_CAP) -> None:
        self.table, self.cap = CommittedTable(spark, path), cap

    def update(self, records: DataFrame, writer: str, batch: int) -> None:
        versions = self.table.commits_of(writer)
        if versions and batch <= versions[-1][0]:
            return
        lists = alert_rows(alerts(records))
        if versions:
            lists = lists.unionByName(self.table.read_commit(versions[-1][1])
                                      .select(*lists.columns))
        self.table.append(self._merged(lists), writer, batch)
        for _, name in versions[:-1]:
            self.table.drop_commit(name)

    def _merged(self, lists: DataFrame) -> DataFrame:
        return top_per_group(lists, ["run_id"], (*NEWEST, "-alert"), self.cap, unique="event_id")

    def read(self) -> DataFrame:
        """The list over all writers."""
        lists = [self.table.read_commit(self.table.commits_of(w)[-1][1])
                 for w in self.table.writers()]
        if not lists:
            raise ValueError("no list was written")
        return self._merged(reduce(DataFrame.unionByName, lists)).select(
            "run_id", "event_id", "processed_at_epoch_ms", "alert")


RUN_COLUMNS = ["run_id", "status", "expected_count", "sent_count", "started_at_epoch_ms",
               "producer_finished_at_epoch_ms", "external_enabled", "version"]


def run_registry(updates: DataFrame) -> DataFrame:
    """Current state of each run from its update records: for every field the last value
    given, in ``version`` order."""
    fields = [c for c in RUN_COLUMNS if c not in ("run_id", "version")]
    return updates.groupBy("run_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in fields],
        F.max("version").alias("version"))


def update_runs(updates: DataFrame, path: str) -> None:
    updates.select(*RUN_COLUMNS).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return run_registry(spark.read.parquet(path))


def write_results(df: DataFrame, path: str) -> None:
    """Result tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
