"""Sources and sinks: tables written and read back, replay messages, decision table."""

from __future__ import annotations


from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.calibration import params_table
from sieveguard.functions.columns import alerts
from sieveguard.operators.aggregates import mode_comparison, scaler_stats
from sieveguard.scratch import scratch_path
from sieveguard.sources import readings as src
from sieveguard.sources import sinks
from workload.base import (
    ORDER, PLAIN, SQL_FEATURES, SQL_READINGS, SQL_RECORDS, features, query, readings, records,
    rounded, s6, sql, two_mode_events, two_mode_records)

READING_SQL = sql(SQL_READINGS, f"select {', '.join(PLAIN)} from r")


@query("src_json_files", READING_SQL)
def _(spark, sf):
    path = scratch_path(spark, "json")
    readings(spark, sf).select(*[f.name for f in S.READING.fields]).write.json(path)
    return src.read_json(spark, path).select(*[c.strip('"') for c in PLAIN])


@query("src_kafka_json", READING_SQL)
def _(spark, sf):
    rows = readings(spark, sf)
    body = F.to_json(F.struct(*[f.name for f in S.READING.fields]))
    return src.parse_readings(rows.select(body.alias("value"))).select(
        *[c.strip('"') for c in PLAIN])


@query("src_parquet_readings", sql(SQL_READINGS, """
select "date", "time", "timestamp", epoch, moteid, temperature, humidity, light, voltage, label,
  anomaly_type from r"""))
def _(spark, sf):
    path = scratch_path(spark, "recorded")
    readings(spark, sf).drop("timestamp").write.parquet(path)
    return src.read_parquet_readings(spark, path).drop("event_id", "ts")


@query("src_text_readings", sql(SQL_READINGS, """
select "date", "time", epoch, moteid, temperature, humidity, light, voltage, "timestamp"
from r where anomaly_type <> 'FLATLINE'"""))
def _(spark, sf):
    # Drift lines carry extra words, flatline lines lack the last one.
    kind = F.col("anomaly_type")
    words = ["date", "time", "epoch", "moteid", "temperature", "humidity", "light"]
    line = F.concat_ws("  ", *words, F.when(kind != "FLATLINE", F.col("voltage")),
                       F.when(kind == "DRIFT", F.lit("extra words")))
    path = scratch_path(spark, "text")
    readings(spark, sf).select(F.concat(F.lit(" "), line).alias("value")).write.text(path)
    return src.read_text_readings(spark, path).drop("event_id", "ts")


def scaler_sql(name: str = "feature", extra: str = "") -> str:
    return "\nunion all\n".join(
        f"select '{c}' as {name}, {s6(f'avg({c})', 'mean')}, "
        f"{s6(f'stddev_pop({c}) + 1e-4', 'std')}{extra} from f" for c in S.FEATURES)


@query("src_calibration_json", sql(SQL_FEATURES, scaler_sql(
    extra=", 'reconstruction' as model, 5e-1 as coef, -125e-2 as intercept")))
def _(spark, sf):
    stats = scaler_stats(features(spark, sf))
    packed = F.collect_list(F.struct("feature", "mean", "std"))  # ten rows
    one = stats.agg(packed.alias("s")).select(
        F.lit(0.5).alias("coef"), F.lit(-1.25).alias("intercept"),
        F.col("s.mean").alias("means"), F.col("s.std").alias("stds"),
        F.col("s.feature").alias("features"))
    path = scratch_path(spark, "calibration")
    one.write.json(path)
    return rounded(params_table(spark, path, "reconstruction"), "mean", "std")


@query("replay_stamp", sql(SQL_READINGS, """
select row_number() over (order by ts, seq) as n,
  'run-b:' || cast(row_number() over (order by ts, seq) as varchar) as event_id,
  'run-b' as run_id, cast(moteid as varchar) as "key", 1700000000000 as sent_at_epoch_ms,
  temperature, epoch from r"""))
def _(spark, sf):
    out = sinks.stamp_replay(readings(spark, sf), "run-b", ORDER, now_ms=1_700_000_000_000)
    return out.select("n", "event_id", "run_id", "key", "sent_at_epoch_ms", "temperature", "epoch")


@query("sink_kafka", sql(SQL_READINGS + """,
n as (select *, row_number() over (order by ts, seq) as n from r)""", """
select cast(moteid as varchar) as "key", count(*) as messages,
  cast(sum(epoch) as bigint) as epochs, max('run-b:' || cast(n as varchar)) as last_event
from n group by moteid"""))
def _(spark, sf):
    out = sinks.stamp_replay(readings(spark, sf), "run-b", ORDER, now_ms=1_700_000_000_000)
    sent = src.parse_readings(out.select("value"))
    return sent.groupBy(F.col("moteid").cast("string").alias("key")).agg(
        F.count("*").alias("messages"), F.sum("epoch").alias("epochs"),
        F.max("event_id").alias("last_event"))


@query("event_row_projection", sql(SQL_RECORDS, f"""
select run_id, event_id, substr(replace("timestamp", 'T', ' '), 1, 23) as "timestamp", "date",
  epoch, moteid, temperature, humidity, light, voltage, label as ground_truth, is_anomaly,
  prediction, {s6('p_if')}, {s6('p_ae')}, {s6('p_final')},
  case when uncertain then 1 else 0 end as uncertain,
  case when escalated then 1 else 0 end as escalated, system_name, engine, inference_status,
  {s6('anomaly_score')}, anomaly_reasons, anomaly_type, sent_at_epoch_ms, processed_at_epoch_ms,
  processing_latency_ms from rec where system_name = 'selective'"""))
def _(spark, sf):
    return rounded(sinks.event_rows(records(spark, sf)), "p_if", "p_ae", "p_final",
                   "anomaly_score")


@query("sink_events_table", sql(SQL_RECORDS, f"""
select event_id, system_name, engine, is_anomaly, {s6('p_final')}, processed_at_epoch_ms
from rec"""))
def _(spark, sf):
    path = scratch_path(spark, "events")
    events = two_mode_events(spark, sf).persist()
    sinks.append_events(events, 0, path)
    sinks.append_events(events, 0, path)  # a retried batch replaces itself
    sinks.append_events(events, 1, path)  # a repeated delivery leaves duplicates
    events.unpersist()
    current = sinks.current_events(spark, path, ("run_id", "event_id", "system_name"))
    return rounded(current.select("event_id", "system_name", "engine", "is_anomaly", "p_final",
                                  "processed_at_epoch_ms"), "p_final")


@query("sink_alerts_capped", sql(SQL_RECORDS + """,
a as (select *, row_number() over (partition by run_id, system_name
    order by processed_at_epoch_ms desc, event_id desc) as place
  from rec where is_anomaly = 1 and system_name = 'selective')""", """
select run_id, event_id, processed_at_epoch_ms, prediction, moteid from a where place <= 500"""))
def _(spark, sf):
    out = sinks.capped_alerts(sinks.event_rows(records(spark, sf)), cap=500)
    return out.select("run_id", "event_id", "processed_at_epoch_ms",
                      F.get_json_object("alert", "$.prediction").alias("prediction"),
                      F.get_json_object("alert", "$.moteid").cast("int").alias("moteid"))


@query("sink_alert_console", sql(SQL_RECORDS, f"""
select event_id, system_name, prediction, {s6('p_final')} from rec where is_anomaly = 1"""))
def _(spark, sf):
    return rounded(alerts(two_mode_records(spark, sf)).select(
        "event_id", "system_name", "prediction", "p_final"), "p_final")


def run_updates(spark, sf):
    """Start and finish records of one run per event type."""
    counts = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count()
    start = counts.select(
        F.concat(F.lit("run-"), "event_type").alias("run_id"), F.lit("starting").alias("status"),
        F.col("count").alias("expected_count"), F.lit(0).cast("long").alias("sent_count"),
        F.lit(1000).cast("long").alias("started_at_epoch_ms"),
        F.lit(None).cast("long").alias("producer_finished_at_epoch_ms"),
        (F.col("event_type") == "error").alias("external_enabled"), F.lit(1).alias("version"))
    done = start.where(F.col("run_id") != "run-view").withColumns({
        "status": F.lit("producer_finished"), "sent_count": F.col("expected_count"),
        "expected_count": F.lit(None).cast("long"),
        "started_at_epoch_ms": F.lit(None).cast("long"),
        "producer_finished_at_epoch_ms": F.lit(9000).cast("long"),
        "external_enabled": F.lit(None).cast("boolean"), "version": F.lit(2)})
    return start.unionByName(done)


@query("run_registry", """
select 'run-' || event_type as run_id,
  case when event_type = 'view' then 'starting' else 'producer_finished' end as status,
  count(*) as expected_count,
  case when event_type = 'view' then cast(0 as bigint) else count(*) end as sent_count,
  cast(1000 as bigint) as started_at_epoch_ms,
  case when event_type <> 'view' then cast(9000 as bigint) end as producer_finished_at_epoch_ms,
  event_type = 'error' as external_enabled, case when event_type = 'view' then 1 else 2 end as version
from events group by event_type""")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    sinks.update_runs(run_updates(spark, sf), path)
    return sinks.read_runs(spark, path)


@query("write_results_csv", sql(SQL_RECORDS, f"""
select system_name as "mode", count(*) as events,
  {s6('cast(sum(case when escalated then 1 else 0 end) as double) / count(*)', 'escalation_rate')}
from rec group by system_name"""))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    table = mode_comparison(two_mode_events(spark, sf)).select("mode", "events", "escalation_rate")
    sinks.write_results(table, path)
    return rounded(sinks.read_results(spark, path, table.schema), "escalation_rate")
