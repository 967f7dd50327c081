"""Streaming runs over the events table, drained and read back."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.external import external_decision
from sieveguard.functions.columns import heuristic_prob
from sieveguard.plans.flow import decide_records
from sieveguard.scratch import scratch_path, written
from sieveguard.sources.commits import CommittedTable
from sieveguard.sources.readings import BATCH_FILES
from sieveguard.sources.sinks import AlertList, event_table, read_events
from sieveguard.streaming.features import stream_features
from sieveguard.streaming.run import (
    SERIES_COUNTS, fan_out, read_series, run_external, run_series, run_stream, series_table,
    stream_dedup, stream_series, writer_name)
from workload.base import (
    ORDER, SQL_READINGS, SQL_RECORDS, WEIGHTS, probabilities, processed_at, query, records,
    rounded, s6, sensor_rows, sql)
from workload.models import answer
from workload.windows import DERIVED, FEATURE_SQL

DRAIN = {"availableNow": True}


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream of readings."""
    layout = spark.read.parquet(f"{sf}/events.parquet").schema
    return sensor_rows(spark.readStream.schema(layout).option(
        "pathGlobFilter", "events.parquet").parquet(sf))


SLICES = 8
FILE_ROWS = 125_000   # of a slice's file, about; a busy user's rows stay in one


def slice_ends(spark: SparkSession, sf: str) -> list[int]:
    """Times that part the events into slices. They come from a sketch and may differ from call to
    call: slices that are put in several steps need the same ones."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.percentile_approx(
        at, [i / SLICES for i in range(1, SLICES)])).first()[0]


def moment(micros: int) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def put_slices(spark: SparkSession, sf: str, path: str, first: int, last: int,
               ends: list[int] | None = None) -> None:
    """Add slices ``first`` up to ``last`` of the events by time, each after the one before.

    A slice may be several files; each holds whole users, so their order does not matter.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    ends = [moment(e) for e in (slice_ends(spark, sf) if ends is None else ends) or []]
    slices = []
    for i in range(first, last):
        own = F.lit(True)
        if i:
            own = own & (F.col("ts") > ends[i - 1])
        if i < SLICES - 1:
            own = own & (F.col("ts") <= ends[i])
        slices.append(own)
    sizes = events.agg(*[F.count_if(own) for own in slices]).first()
    for own, size in zip(slices, sizes):
        events.where(own).repartition(max(1, -(-size // FILE_ROWS)), "user_id").write.mode(
            "append").parquet(path)


def sliced_stream(spark: SparkSession, path: str, slices: int = SLICES) -> DataFrame:
    """The written slices as a stream, about a slice in each micro-batch.

    A micro-batch costs a fixed time besides its rows, so their number must not grow with the
    files of a slice; it takes BATCH_FILES of them at most.
    """
    slices_now = spark.read.parquet(path)
    files = min(BATCH_FILES, max(1, -(-len(slices_now.inputFiles()) // slices)))
    return sensor_rows(spark.readStream.schema(slices_now.schema).option(
        "maxFilesPerTrigger", files).parquet(path))


def decided(readings: DataFrame) -> DataFrame:
    feats = stream_features(readings, order=ORDER)
    return decide_records(feats, probabilities, heuristic_prob(WEIGHTS), "selective",
                          processed_at())


def sliced_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "slices")
    put_slices(spark, sf, path, 0, SLICES)
    return decided(sliced_stream(spark, path))


def record_stream(spark: SparkSession, sf: str) -> DataFrame:
    return decided(event_stream(spark, sf))


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input is used up and read what it wrote."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", scratch_path(spark, f"{name}_state"))
     .trigger(**DRAIN).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(path)


@query("stream_features", FEATURE_SQL)
def _(spark, sf):
    path = scratch_path(spark, "slices")
    put_slices(spark, sf, path, 0, SLICES)
    out = drained(stream_features(sliced_stream(spark, path), order=ORDER), "stream_features")
    return rounded(out.select("seq", "moteid", *S.FEATURES), *DERIVED)


@query("stream_score", sql(SQL_RECORDS, f"""
select seq, {s6('p_if')}, {s6('p_ae')}, uncertain, escalated, {s6('p_final')}, is_anomaly,
  prediction, anomaly_reasons, engine from rec where system_name = 'selective'"""))
def _(spark, sf):
    out = drained(sliced_records(spark, sf), "stream_score")
    return rounded(out.select("seq", "p_if", "p_ae", "uncertain", "escalated", "p_final",
                              "is_anomaly", "prediction", "anomaly_reasons", "engine"),
                   "p_if", "p_ae", "p_final")


FANOUT_SQL = sql(SQL_RECORDS, """
select 'events' as branch, event_id from rec where system_name = 'selective'
union all select 'alerts', event_id from rec where system_name = 'selective' and is_anomaly = 1
union all select 'uncertain', event_id from rec where system_name = 'selective' and uncertain""")


def branches_of(spark: SparkSession, path: str) -> DataFrame:
    parts = [read_events(spark, f"{path}/events").select(
        F.lit("events").alias("branch"), "event_id")]
    for name in ("alerts", "uncertain"):
        parts.append(CommittedTable(spark, f"{path}/{name}").read().select(
            F.lit(name).alias("branch"), "event_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_fanout", FANOUT_SQL)
def _(spark, sf):
    path = scratch_path(spark, "fanout")
    run_stream(sliced_records(spark, sf), path, scratch_path(spark, "fanout_state"),
               DRAIN).awaitTermination()
    return branches_of(spark, path)


@query("stream_fanout_restart", FANOUT_SQL)
def _(spark, sf):
    """Stopped after half of the input and started again from its checkpoint."""
    path, state = scratch_path(spark, "fanout"), scratch_path(spark, "fanout_state")
    source = scratch_path(spark, "slices")
    ends = slice_ends(spark, sf)
    for first, last in ((0, SLICES // 2), (SLICES // 2, SLICES)):
        put_slices(spark, sf, source, first, last, ends)
        run_stream(decided(sliced_stream(spark, source, last)), path, state, DRAIN).awaitTermination()
    return branches_of(spark, path)


@query("stream_external", sql(SQL_RECORDS, """
select seq as epoch, 'fallback' as engine, is_anomaly from rec
where system_name = 'selective' and escalated
union all
select seq, 'external', case when p_if >= 2e-1 then case when p_if >= 4e-1 then 1 else 0 end end
from rec where system_name = 'selective' and uncertain"""))
def _(spark, sf):
    """Open cases decided by a second stream over the table that the first one wrote."""
    path, records = scratch_path(spark, "beside"), sliced_records(spark, sf)
    run_stream(records, path, scratch_path(spark, "main_state"), DRAIN).awaitTermination()
    run_external(spark, path, scratch_path(spark, "external_state"),
                 lambda cases: external_decision(cases, partial(answer, limit=0.4), concurrency=2),
                 DRAIN).awaitTermination()
    rows = read_events(spark, f"{path}/events").where("engine <> 'fast-path'")
    return rows.select(F.col("epoch").cast("long").alias("epoch"), "engine", "is_anomaly")


@query("stream_external_retry", sql(SQL_RECORDS, """
select seq as epoch, 'fallback' as engine, is_anomaly from rec
where system_name = 'selective' and escalated
union all
select seq, 'external', case when p_if >= 2e-1 then case when p_if >= 4e-1 then 1 else 0 end end
from rec where system_name = 'selective' and uncertain"""))
def _(spark, sf):
    """The main stream tries its first batch again, with other times, after the second stream has
    read it; then both go on. Every case is decided once."""
    path, source = scratch_path(spark, "retried"), scratch_path(spark, "slices")
    states = scratch_path(spark, "main_state"), scratch_path(spark, "external_state")
    ends = slice_ends(spark, sf)
    for first, last in ((0, SLICES // 2), (SLICES // 2, SLICES)):
        put_slices(spark, sf, source, first, last, ends)
        run_stream(decided(sliced_stream(spark, source, last)), path, states[0],
                   DRAIN).awaitTermination()
        run_external(spark, path, states[1],
                     lambda cases: external_decision(cases, partial(answer, limit=0.4), concurrency=2),
                     DRAIN).awaitTermination()
        again = CommittedTable(spark, f"{path}/uncertain").read().where("batch = 0").drop(
            "written_at_epoch_ms", "writer", "batch")
        fan_out(path, writer=writer_name(states[0]))(
            again.withColumn("processed_at_epoch_ms", F.lit(1).cast("long")), 0)
    rows = read_events(spark, f"{path}/events").where("engine <> 'fast-path'")
    return rows.select(F.col("epoch").cast("long").alias("epoch"), "engine", "is_anomaly")


@query("sink_events_compacted", sql(SQL_RECORDS, f"""
select event_id, engine, is_anomaly, {s6('p_final')}, processed_at_epoch_ms
from rec where system_name = 'selective'"""))
def _(spark, sf):
    """A table compacted and cleaned while a stream adds to it, which stops and starts again."""
    path, state = scratch_path(spark, "compacted"), scratch_path(spark, "compacted_state")
    source, table = scratch_path(spark, "slices"), event_table(spark, f"{path}/events")

    def tidy(batch: DataFrame, batch_id: int) -> None:
        if batch_id % 3 == 2:
            table.compact()
            table.clean(grace_ms=0)

    ends = slice_ends(spark, sf)
    for first, last in ((0, SLICES // 2), (SLICES // 2, SLICES)):
        put_slices(spark, sf, source, first, last, ends)
        run_stream(decided(sliced_stream(spark, source, last)), path, state, DRAIN,
                   tidy).awaitTermination()
    rows = read_events(spark, f"{path}/events")
    return rounded(rows.select("event_id", "engine", "is_anomaly", "p_final",
                               "processed_at_epoch_ms"), "p_final")


@query("stream_alerts_capped", sql(SQL_RECORDS + """,
a as (select *, row_number() over (partition by run_id
    order by processed_at_epoch_ms desc, event_id desc) as place
  from rec where is_anomaly = 1 and system_name = 'selective')""", """
select run_id, event_id, processed_at_epoch_ms, prediction, moteid from a where place <= 300"""))
def _(spark, sf):
    """The list that a stream keeps, after its last batch."""
    path = scratch_path(spark, "listed")
    run_stream(sliced_records(spark, sf), path, scratch_path(spark, "listed_state"), DRAIN,
               alert_cap=300).awaitTermination()
    out = AlertList(spark, f"{path}/alert_list", 300).read()
    body = F.from_json("alert", "prediction string, moteid int")
    return out.select("run_id", "event_id", "processed_at_epoch_ms",
                      body["prediction"].alias("prediction"), body["moteid"].alias("moteid"))


@query("stream_state_expiry", FEATURE_SQL.replace(
    "partition by moteid order by", "partition by moteid, seq % 2 order by"))
def _(spark, sf):
    """Every sensor is silent for longer than its state lives between two halves of the events."""
    source, out = scratch_path(spark, "halves"), scratch_path(spark, "expired")
    state = scratch_path(spark, "expired_state")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition("user_id").write.mode(
            "append").parquet(source)
        stream = sensor_rows(spark.readStream.schema(events.schema).parquet(source))
        feats = stream_features(stream, order=ORDER, expiry_ms=1)
        (feats.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .trigger(**DRAIN).start().awaitTermination())
    return rounded(spark.read.schema(feats.schema).parquet(out).select(
        "seq", "moteid", *S.FEATURES), *DERIVED)


@query("stream_dedup", sql(SQL_READINGS, "select seq, moteid from r"))
def _(spark, sf):
    stream = event_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = stream_dedup(twice, "at", "1 hour", key=("run_id", "event_id"))
    return drained(kept.select("seq", "moteid"), "stream_dedup")


@query("stream_series", sql(SQL_RECORDS, """
select cast(processed_at_epoch_ms // 3600000 * 3600000 as bigint) as bucket_ms,
  count(*) as readings, count(*) filter (is_anomaly = 1) as anomalies,
  count(*) filter (escalated) as escalated
from rec where system_name = 'selective' group by 1"""))
def _(spark, sf):
    series = stream_series(record_stream(spark, sf), "1 hour", "1 minute")
    path, state = scratch_path(spark, "series"), scratch_path(spark, "series_state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (series.writeStream.outputMode("complete").foreachBatch(save)
     .option("checkpointLocation", state).trigger(**DRAIN).start().awaitTermination())
    every = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = every.agg(F.max("batch")).scalar()
    return every.where(F.col("batch") == last).select(
        "bucket_ms", "readings", "anomalies", "escalated")


SERIES_PARTS = {"1m": 60_000, "1h": 3_600_000, "6h": 21_600_000, "24h": 86_400_000}


@query("stream_series_late", sql(SQL_RECORDS, "\nunion all\n".join(f"""
select '{name}' as window, cast(processed_at_epoch_ms // {size} * {size} as bigint) as bucket_ms,
  count(*) as readings, count(*) filter (is_anomaly = 1) as anomalies,
  count(*) filter (escalated) as escalated
from rec where system_name = 'selective' group by 2""" for name, size in SERIES_PARTS.items())))
def _(spark, sf):
    """The later half of the records comes first, and a part of them comes twice."""
    rows = written(records(spark, sf), "series_rows")
    source, path = scratch_path(spark, "late"), scratch_path(spark, "series")
    late = rows.where("seq % 2 = 0")
    for part in (rows.where("seq % 2 = 1"), late, rows.where("seq % 5 = 0")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_series(stream, path, scratch_path(spark, "series_state"), "400 days",
               trigger=DRAIN).awaitTermination()
    series_table(spark, path).compact()
    parts = [read_series(spark, path, size).select(F.lit(name).alias("window"), "bucket_ms",
                                                   *SERIES_COUNTS)
             for name, size in SERIES_PARTS.items()]
    return reduce(DataFrame.unionAll, parts)
