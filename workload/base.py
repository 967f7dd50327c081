"""Sensor readings derived from the ``events`` table, and the shared SQL steps.

The detectors used in checked queries are fixed formulas over the z-scores, so that the
same values can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.functions.columns import (
    calibrated_prob, ensemble_mean, heuristic_prob, uncertainty_gate)
from sieveguard.operators.windows import dual_window_features
from sieveguard.plans.flow import both_modes, decide_records
from sieveguard.sources.sinks import event_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ("ts", "seq")

# Reading columns, quoted for SQL where needed.
PLAIN = ['"date"', '"time"', '"timestamp"', "run_id", "event_id", "anomaly_type",
         "sent_at_epoch_ms", "label", "epoch", "moteid", "temperature", "humidity", "light",
         "voltage"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(c: Column | str) -> Column:
    """Round for comparison; the shift keeps values off decimal ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1.83e-7, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def s6(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1.83e-7, 6) as {name or expr}"


def sensor_rows(events: DataFrame) -> DataFrame:
    """The events table (batch or stream) as sensor readings."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind, value = F.col("event_type"), F.col("value")
    spike = (kind == "error") & (value >= 60)
    drift = (kind == "purchase") & (value >= 90)
    flat = (kind == "signup") & (k < 2)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    key = F.col("event_id").cast("string")
    return events.select(
        F.lit("run-a").alias("run_id"), F.concat(F.lit("run-a:"), key).alias("event_id"),
        F.col("event_id").alias("seq"), "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("time"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("event_id").cast("int").alias("epoch"), F.col("user_id").cast("int").alias("moteid"),
        value.alias("temperature"), (30 + k * 0.5).alias("humidity"),
        ((k * 7) % 500).cast("double").alias("light"), (2 + k * 0.01).alias("voltage"),
        F.when(spike | drift | flat, 1).otherwise(0).alias("label"),
        F.when(spike, "SPIKE_TEMP").when(drift, "DRIFT").when(flat, "FLATLINE")
        .otherwise("NORMAL").alias("anomaly_type"),
        F.floor(micros / 1000).cast("long").alias("sent_at_epoch_ms"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return sensor_rows(spark.read.parquet(f"{sf}/events.parquet"))


def features(spark: SparkSession, sf: str, keep: bool = False) -> DataFrame:
    return dual_window_features(readings(spark, sf), order=ORDER, keep_window_columns=keep)


def probabilities(df: DataFrame) -> DataFrame:
    zt, zv = F.col("z_temp_15m"), F.col("z_volt_15m")
    return df.withColumns({
        "p_if": calibrated_prob(F.abs(zt), 2.0, -3.0),
        "p_ae": calibrated_prob((zt * zt + zv * zv) / 2.0, 0.8, -2.0),
    })


# Rule weights of the checked queries: readings here vary more than temperatures.
WEIGHTS = {"rate": 1.2 / 50.0, "offset": -4.0}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Features, both probabilities, gate, and the stronger score of every row."""
    gated = uncertainty_gate(probabilities(features(spark, sf)))
    return gated.withColumn("p_fallback", heuristic_prob(WEIGHTS))


def processed_at() -> Column:
    return F.col("sent_at_epoch_ms") + (F.col("seq") * 37) % 5000


def records(spark: SparkSession, sf: str, mode: str = "selective") -> DataFrame:
    return decide_records(features(spark, sf), probabilities, heuristic_prob(WEIGHTS), mode,
                          processed_at())


def two_mode_records(spark: SparkSession, sf: str) -> DataFrame:
    return both_modes(features(spark, sf), probabilities, heuristic_prob(WEIGHTS), processed_at())


def two_mode_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(two_mode_records(spark, sf))


def mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).withColumn("p_final", F.when(
        F.col("uncertain"), F.col("p_fallback")).otherwise(ensemble_mean()))


SQL_READINGS = """
e as (
  select event_id, ts, user_id, event_type, value,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
r as (
  select 'run-a' as run_id, 'run-a:' || cast(event_id as varchar) as event_id,
    event_id as seq, ts, strftime(ts, '%Y-%m-%d') as "date",
    strftime(ts, '%H:%M:%S.%f') as "time",
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as "timestamp",
    cast(event_id as int) as epoch, cast(user_id as int) as moteid, value as temperature,
    30 + k * 5e-1 as humidity, cast((k * 7) % 500 as double) as light, 2 + k * 1e-2 as voltage,
    case when event_type = 'error' and value >= 60 then 1
      when event_type = 'purchase' and value >= 90 then 1
      when event_type = 'signup' and k < 2 then 1 else 0 end as label,
    case when event_type = 'error' and value >= 60 then 'SPIKE_TEMP'
      when event_type = 'purchase' and value >= 90 then 'DRIFT'
      when event_type = 'signup' and k < 2 then 'FLATLINE' else 'NORMAL' end as anomaly_type,
    epoch_us(ts) // 1000 as sent_at_epoch_ms
  from e)"""

SQL_FEATURES = SQL_READINGS + """,
w as (
  select *, count(*) over w30 as n,
    avg(temperature) over w6 as short_temp_mean, avg(voltage) over w6 as short_volt_mean,
    avg(temperature) over w30 as mt, avg(voltage) over w30 as mv,
    stddev_samp(temperature) over w30 as st, stddev_samp(voltage) over w30 as sv,
    lag(temperature, 10) over wo as lagged
  from r
  window wo as (partition by moteid order by ts, seq),
    w6 as (partition by moteid order by ts, seq rows between 5 preceding and current row),
    w30 as (partition by moteid order by ts, seq rows between 29 preceding and current row)),
f as (
  select *, case when n >= 3 then mt end as long_temp_mean,
    case when n >= 3 then mv end as long_volt_mean,
    case when n >= 3 then st else 1e-1 end as long_temp_std,
    case when n >= 3 then sv else 1e-2 end as long_volt_std,
    temperature - short_temp_mean as delta_temp_3m, voltage - short_volt_mean as delta_volt_3m,
    case when n >= 3 then (temperature - mt) / (st + 1e-4) else 0e0 end as z_temp_15m,
    case when n >= 3 then (voltage - mv) / (sv + 1e-4) else 0e0 end as z_volt_15m,
    coalesce((temperature - lagged) / 10e0, 0e0) as temp_slope_15m,
    case when n >= 3 then st * st else 1e-2 end as var_temp_15m
  from w)"""

SQL_SCORED = SQL_FEATURES + """,
p as (
  select *,
    1e0 / (1e0 + exp(-greatest(-25e0, least(25e0, 2e0 * abs(z_temp_15m) - 3e0)))) as p_if,
    1e0 / (1e0 + exp(-greatest(-25e0, least(25e0, 8e-1 * (z_temp_15m * z_temp_15m
      + z_volt_15m * z_volt_15m) / 2e0 - 2e0)))) as p_ae
  from f),
g as (
  select *, (p_if >= 5e-1) <> (p_ae >= 5e-1) as disagreement,
    (p_if > 35e-2 and p_if < 65e-2) or (p_ae > 35e-2 and p_ae < 65e-2)
      or ((p_if >= 5e-1) <> (p_ae >= 5e-1)) as uncertain,
    5e-1 * (p_if + p_ae) as p_mean,
    15e-1 * abs(p_if - p_ae) + (1 - 2e0 * abs(p_if - 5e-1)) + (1 - 2e0 * abs(p_ae - 5e-1))
      as uncertainty,
    1e0 / (1e0 + exp(-greatest(-15e0, least(15e0, 18e-1 * p_if + 2e0 * p_ae
      + 7e-1 * (abs(z_temp_15m) + abs(z_volt_15m))
      + 12e-1 / 50e0 * (abs(temp_slope_15m) + abs(delta_temp_3m))
      + 5e-1 * abs(p_if - p_ae) - 4e0)))) as p_fallback
  from p)"""

SQL_RECORDS = SQL_SCORED + """,
m as (
  select g.*, v.system_name, v.system_name = 'selective' and uncertain as escalated,
    case when v.system_name = 'selective' and uncertain then p_fallback else p_mean end as p_final,
    sent_at_epoch_ms + (seq * 37) % 5000 as processed_at_epoch_ms
  from g, (values ('fast'), ('selective')) v(system_name)),
rec as (
  select *, case when p_final >= 5e-1 then 1 else 0 end as is_anomaly,
    case when p_final >= 5e-1 then 'ANOMALY' else 'NORMAL' end as prediction,
    p_final as anomaly_score,
    case when p_final < 5e-1 then case when escalated then 'FALLBACK_NORMAL' else 'NORMAL' end
      when escalated and disagreement then 'FALLBACK_AFTER_DISAGREEMENT'
      when escalated then 'FALLBACK_AFTER_MARGIN_UNCERTAINTY'
      else 'FAST_PATH_ANOMALY' end as anomaly_reasons,
    case when escalated then 'fallback' else 'fast-path' end as engine,
    'OK' as inference_status,
    cast(greatest(0, processed_at_epoch_ms - sent_at_epoch_ms) as double)
      as processing_latency_ms
  from m)"""


def sql(steps: str, select: str) -> str:
    return f"with {steps.strip()}\n{select.strip()}"
