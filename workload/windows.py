"""Row windows per sensor, order, and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.operators import windows as W
from sieveguard.operators.dedup import latest_by_key
from sieveguard.operators.ordering import ordered_sequence
from sieveguard.operators.ranking import SKETCH_ERROR, running_latency, running_quality
from sieveguard.scratch import written
from workload.base import (
    ORDER, SQL_FEATURES, SQL_READINGS, SQL_RECORDS, features, query, readings, records, rounded,
    s6, sql, two_mode_events)

DERIVED = S.FEATURES[4:]
FEATURE_SQL = sql(SQL_FEATURES, "select seq, moteid, temperature, humidity, light, voltage, "
                  + ", ".join(s6(c) for c in DERIVED) + " from f")


def feature_rows(df):
    return rounded(df.select("seq", "moteid", *S.FEATURES), *DERIVED)


@query("dual_window_features", FEATURE_SQL)
def _(spark, sf):
    return feature_rows(features(spark, sf))


@query("dual_window_features_busy_sensors", FEATURE_SQL)
def _(spark, sf):
    """The same result when sensors with over 65 rows are computed in blocks."""
    return feature_rows(W.dual_window_features(readings(spark, sf), order=ORDER, busy_rows=65))


@query("rolling_mean_6", sql(SQL_FEATURES, f"""
select seq, {s6('short_temp_mean')}, {s6('short_volt_mean')} from f"""))
def _(spark, sf):
    rows = readings(spark, sf)
    for c, name in (("temperature", "short_temp_mean"), ("voltage", "short_volt_mean")):
        rows = W.rolling_stats(rows, c, S.SHORT_ROWS, order=ORDER).withColumnRenamed(
            f"{c}_mean", name)
    return rounded(rows.select("seq", "short_temp_mean", "short_volt_mean"),
                   "short_temp_mean", "short_volt_mean")


@query("short_delta", sql(SQL_FEATURES, f"""
select seq, {s6('delta_temp_3m')}, {s6('delta_volt_3m')} from f"""))
def _(spark, sf):
    names = ["delta_temp_3m", "delta_volt_3m"]
    return rounded(features(spark, sf).select("seq", *names), *names)


@query("rolling_mean_30", sql(SQL_FEATURES, f"""
select seq, n, {s6('long_temp_mean')} from f"""))
def _(spark, sf):
    out = W.rolling_stats(readings(spark, sf), "temperature", S.LONG_ROWS, S.MIN_LONG_VALUES,
                          order=ORDER)
    return rounded(out.select("seq", F.col("temperature_n").alias("n"),
                              F.col("temperature_mean").alias("long_temp_mean")),
                   "long_temp_mean")


@query("rolling_std_30", sql(SQL_FEATURES, f"""
select seq, {s6('long_temp_std')}, {s6('long_volt_std')} from f"""))
def _(spark, sf):
    names = ["long_temp_std", "long_volt_std"]
    return rounded(features(spark, sf, keep=True).select("seq", *names), *names)


@query("rolling_z", sql(SQL_FEATURES, f"""
select seq, {s6('z_temp_15m')}, {s6('z_volt_15m')} from f"""))
def _(spark, sf):
    names = ["z_temp_15m", "z_volt_15m"]
    return rounded(features(spark, sf).select("seq", *names), *names)


@query("lag_slope", sql(SQL_FEATURES, f"select seq, {s6('temp_slope_15m')} from f"))
def _(spark, sf):
    return rounded(features(spark, sf).select("seq", "temp_slope_15m"), "temp_slope_15m")


@query("rolling_var_30", sql(SQL_FEATURES, f"select seq, {s6('var_temp_15m')} from f"))
def _(spark, sf):
    out = W.rolling_stats(readings(spark, sf), "temperature", S.LONG_ROWS, S.MIN_LONG_VALUES,
                          order=ORDER, default_std=S.WARMUP_TEMP_STD)
    return rounded(out.select("seq", F.col("temperature_var").alias("var_temp_15m")),
                   "var_temp_15m")


EXPANDING_SQL = sql(SQL_READINGS + """,
x as (select *, count(*) over u as n, avg(temperature) over u as mean,
    coalesce(var_samp(temperature) over u, 0e0) as var from r
  window u as (partition by moteid order by ts, seq
    rows between unbounded preceding and current row))""", f"""
select seq, n as run_n, {s6('mean', 'run_mean')}, {s6('var', 'run_var')},
  {s6('''case when sqrt(var) > 1e-6 then abs(temperature - mean) / sqrt(var) else 0e0 end''',
      'run_z')} from x""")


def expanding(spark, sf, busy):
    out = W.expanding_stats(readings(spark, sf), "temperature", order=ORDER, busy_rows=busy)
    names = ["run_mean", "run_var", "run_z"]
    return rounded(out.select("seq", *[F.col(f"temperature_{n}").alias(n)
                                       for n in ("run_n", *names)]), *names)


@query("expanding_stats", EXPANDING_SQL)
def _(spark, sf):
    return expanding(spark, sf, W.BUSY_ROWS)


@query("expanding_stats_busy_sensors", EXPANDING_SQL)
def _(spark, sf):
    return expanding(spark, sf, 65)


@query("ordered_sequence", sql(SQL_READINGS, """
select seq, row_number() over (order by ts, seq) - 1 as pos from r"""))
def _(spark, sf):
    return ordered_sequence(readings(spark, sf), ORDER).select("seq", "pos")


@query("ordered_sequence_per_sensor", sql(SQL_READINGS, """
select seq, row_number() over (partition by moteid order by ts, seq) - 1 as pos from r"""))
def _(spark, sf):
    return ordered_sequence(readings(spark, sf), ORDER, by=["moteid"]).select("seq", "pos")


@query("running_quality", sql(SQL_RECORDS + """,
q as (select *, row_number() over (order by ts, seq) as place from rec
  where system_name = 'selective'),
ends as (select place as processed from q where place % 1000 = 0
  union select max(place) from q),
t as (
  select processed, sum(case when label = 1 and is_anomaly = 1 then 1 else 0 end) as tp,
    sum(case when label = 0 and is_anomaly = 1 then 1 else 0 end) as fp,
    sum(case when label = 1 and is_anomaly = 0 then 1 else 0 end) as fn,
    sum(case when escalated then 1e0 else 0e0 end) as up,
    quantile_cont(processing_latency_ms, 5e-1) as p50,
    quantile_cont(processing_latency_ms, 95e-2) as p95
  from ends join q on q.place <= ends.processed group by processed),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0e0) as precision,
    coalesce(tp / nullif(tp + fn, 0), 0e0) as recall from t)""", f"""
select processed, {s6('precision')}, {s6('recall')},
  {s6('coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0)', 'f1')},
  {s6('up * 1e2 / processed', 'escalated_pct')}, {s6('p50')}, {s6('p95')} from pr"""))
def _(spark, sf):
    out = running_quality(records(spark, sf), every=1000, order=ORDER, exact=True)
    return rounded(out, "precision", "recall", "f1", "escalated_pct", "p50", "p95")


@query("running_quality_sketched", sql(SQL_RECORDS + """,
q as (select row_number() over (order by ts, seq) as place from rec
  where system_name = 'selective')""", """
select place as processed, true as p50_ok, true as p95_ok from q where place % 250 = 0
union select max(place), true, true from q"""))
def _(spark, sf):
    """Whether every running quantile of the sketches lies between the exact ones whose ranks
    are off by the error bound."""
    rows = written(records(spark, sf), "quality_records")
    got = running_quality(rows, every=250, order=ORDER)
    placed = ordered_sequence(rows, ORDER, start=1, name="_n").withColumn(
        "_step", F.floor((F.col("_n") - 1) / 250).cast("long"))
    bounds = {f"{n}_{side}": min(1.0, q + e) for n, q in (("p50", 0.5), ("p95", 0.95))
              for side, e in (("low", -SKETCH_ERROR), ("high", SKETCH_ERROR))}
    exact = running_latency(placed, "processing_latency_ms", bounds).join(
        placed.groupBy("_step").agg(F.max("_n").alias("processed")), "_step")
    return got.join(exact, "processed").select("processed", *[
        F.col(n).between(F.floor(f"{n}_low"), F.ceil(f"{n}_high")).alias(f"{n}_ok")
        for n in ("p50", "p95")])


@query("context_window", sql(SQL_READINGS + """,
o as (select *, row_number() over (order by ts, seq) - 1 as pos from r),
c as (select *, row_number() over (partition by anomaly_type order by ts, seq) - 1 as nth from o),
a as (select anomaly_type as around, pos as spot from c
  where (anomaly_type = 'SPIKE_TEMP' and nth = 10) or (anomaly_type = 'DRIFT' and nth = 20)
    or (anomaly_type = 'FLATLINE' and nth = 15))""", """
select around, seq, temperature, cast(pos - spot as int) as "offset" from o join a
  on o.pos >= spot - case around when 'SPIKE_TEMP' then 50 else 60 end
    and o.pos < spot + case around when 'SPIKE_TEMP' then 50 else 60 end"""))
def _(spark, sf):
    rows = readings(spark, sf)
    parts = [W.context_window(rows, kind, nth, reach, reach, ORDER).select(
        F.lit(kind).alias("around"), "seq", "temperature", "offset")
        for kind, nth, reach in (("SPIKE_TEMP", 10, 50), ("DRIFT", 20, 60), ("FLATLINE", 15, 60))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("latest_by_key", sql(SQL_RECORDS + """,
dup as (select run_id, event_id, engine, system_name, processed_at_epoch_ms from rec
  union all select run_id, event_id, engine, system_name, processed_at_epoch_ms + 1 from rec
    where is_anomaly = 1),
v as (select *, row_number() over (partition by run_id, event_id, engine
    order by processed_at_epoch_ms desc, system_name) as version from dup)""", """
select run_id, event_id, engine, system_name, processed_at_epoch_ms from v where version = 1"""))
def _(spark, sf):
    events = two_mode_events(spark, sf).select("run_id", "event_id", "engine", "system_name",
                                               "is_anomaly", "processed_at_epoch_ms")
    again = events.where("is_anomaly = 1").withColumn(
        "processed_at_epoch_ms", F.col("processed_at_epoch_ms") + 1)
    return latest_by_key(events.unionByName(again),
                         order=("-processed_at_epoch_ms", "system_name")).drop("is_anomaly")
