"""Missing values, null order keys, many writers, reports over the written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.fallback import score_fallback
from sieveguard.detectors.forest import fit_forest, score_forest
from sieveguard.detectors.trees import NODE_SCHEMA
from sieveguard.functions.columns import calibrated_prob, heuristic_prob
from sieveguard.operators import aggregates as A
from sieveguard.operators.ordering import take_first
from sieveguard.operators.prepare import chronological_split
from sieveguard.operators.windows import dual_window_features
from sieveguard.plans import reports
from sieveguard.plans.flow import decide_records
from sieveguard.scratch import scratch_path
from sieveguard.sources import readings as src
from sieveguard.sources import sinks
from workload.base import (
    ORDER, SQL_READINGS, SQL_RECORDS, SQL_SCORED, WEIGHTS, features, probabilities, processed_at,
    query, readings, records, rounded, s6, scored, sql, two_mode_events)
from workload.reports import SQL_SUMMARY, runs_of_types, series_sql
from workload.tables import run_updates
from workload.windows import DERIVED, FEATURE_SQL


def every(n: int):
    return F.col("seq") % n == 0


def nan():
    return F.lit(float("nan"))


@query("calibrated_prob_missing", sql(SQL_SCORED, f"""
select seq, {s6('case when seq % 7 <> 0 and seq % 11 <> 0 then p_if end', 'p')} from g"""))
def _(spark, sf):
    score = F.when(every(7), None).when(every(11), nan()).otherwise(F.abs("z_temp_15m"))
    out = scored(spark, sf).withColumn("s", score).select(
        "seq", calibrated_prob("s", 2.0, -3.0).alias("p"))
    return rounded(out, "p")


@query("heuristic_score_missing", sql(SQL_SCORED.replace(
    "abs(delta_temp_3m)", "abs(case when seq % 7 = 0 then 0e0 else delta_temp_3m end)").replace(
    "abs(z_volt_15m))", "abs(case when seq % 11 = 0 then 0e0 else z_volt_15m end))"), f"""
select seq, {s6('case when seq % 13 <> 0 then p_fallback end', 'p')} from g"""))
def _(spark, sf):
    rows = scored(spark, sf).withColumns({
        "delta_temp_3m": F.when(~every(7), F.col("delta_temp_3m")),
        "z_volt_15m": F.when(every(11), nan()).otherwise(F.col("z_volt_15m")),
        "p_ae": F.when(~every(13), F.col("p_ae"))})
    return rounded(rows.select("seq", heuristic_prob(WEIGHTS).alias("p")), "p")


_GAPS = (SQL_RECORDS
         .replace("value as temperature", "case when event_id % 7 <> 0 then value end as temperature")
         .replace("2 + k * 1e-2 as voltage",
                  "case when event_id % 11 <> 0 then 2 + k * 1e-2 end as voltage")
         .replace("count(*) over w30 as n",
                  "count(temperature) over w30 as nt, count(voltage) over w30 as nv")
         .replace("n >= 3 then mt", "nt >= 3 then mt").replace("n >= 3 then mv", "nv >= 3 then mv")
         .replace("n >= 3 then st", "nt >= 3 then st").replace("n >= 3 then sv", "nv >= 3 then sv")
         .replace("n >= 3 then (temperature", "nt >= 3 and temperature is not null then (temperature")
         .replace("n >= 3 then (voltage", "nv >= 3 and voltage is not null then (voltage")
         .replace("abs(delta_temp_3m)", "abs(coalesce(delta_temp_3m, 0e0))"))


@query("records_missing", sql(_GAPS, f"""
select seq, temperature, {s6('delta_temp_3m')}, {s6('z_volt_15m')}, {s6('p_if')}, {s6('p_ae')},
  {s6('p_final')}, is_anomaly, prediction, escalated
from rec where system_name = 'selective'"""))
def _(spark, sf):
    gaps = readings(spark, sf).withColumns({
        "temperature": F.when(~every(7), F.col("temperature")),
        "voltage": F.when(every(11), nan()).otherwise(F.col("voltage"))})
    out = decide_records(dual_window_features(gaps, order=ORDER), probabilities,
                         heuristic_prob(WEIGHTS), "selective", processed_at())
    names = ["delta_temp_3m", "z_volt_15m", "p_if", "p_ae", "p_final"]
    return rounded(out.select("seq", "temperature", *names, "is_anomaly", "prediction",
                              "escalated"), *names)


def untimed(spark, sf):
    return readings(spark, sf).withColumn("ts", F.when(~every(10), F.col("ts")))


_UNTIMED = SQL_READINGS + """,
o as (select seq, row_number() over (
    order by case when seq % 10 <> 0 then ts end nulls first, seq) - 1 as pos,
  count(*) over () as n from r)"""


@query("head_n_null_order", sql(_UNTIMED, """
select seq, switch from o, (values ('sort'), ('slices'), ('default')) v(switch)
where pos < 2 * n // 3"""))
def _(spark, sf):
    """The same rows on both sides of each size switch."""
    rows = untimed(spark, sf)
    n = 2 * rows.count() // 3
    ways = {"sort": {"sort_limit": n}, "slices": {"sort_limit": 100, "slice_rows": 500},
            "default": {}}
    parts = [take_first(rows, ORDER, n, **w).select("seq", F.lit(k).alias("switch"))
             for k, w in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chronological_split_null_order", sql(_UNTIMED, """
select seq, case when pos < cast(floor(n * 6e-1) as bigint) then 'train'
  when pos < cast(floor(n * (6e-1 + 2e-1)) as bigint) then 'val' else 'test' end as split,
  slices from o, (values (500), (50000)) v(slices)"""))
def _(spark, sf):
    small, large = [chronological_split(untimed(spark, sf), order=ORDER, slice_rows=n).select(
        "seq", "split", F.lit(n).alias("slices")) for n in (500, 50_000)]
    return small.unionByName(large)


@query("file_to_features", FEATURE_SQL)
def _(spark, sf):
    """A text file, read, replayed as messages, parsed, and turned into features."""
    words = ["date", "time", "epoch", "moteid", "temperature", "humidity", "light", "voltage"]
    path = scratch_path(spark, "lines")
    readings(spark, sf).select(F.concat_ws(" ", *words).alias("value")).write.text(path)
    sent = sinks.stamp_replay(src.read_text_readings(spark, path), "run-a", ("ts", "epoch"))
    out = dual_window_features(src.parse_readings(sent), order=("ts", "epoch"))
    seq = F.col("epoch").cast("long").alias("seq")
    return rounded(out.select(seq, "moteid", *S.FEATURES), *DERIVED)


@query("sink_events_two_runs", sql(SQL_RECORDS, f"""
select case when seq % 2 = 0 then 'run-a' else 'run-b' end as run_id, seq as epoch, system_name,
  is_anomaly, {s6('p_final')} from rec"""))
def _(spark, sf):
    """Two runs and two modes by four writers, one of which repeats its batch."""
    path = scratch_path(spark, "many")
    half = F.when(F.col("epoch") % 2 == 0, "run-a").otherwise("run-b")
    rows = two_mode_events(spark, sf).withColumn("run_id", half).persist()
    for run in ("run-a", "run-b"):
        for mode in (S.MODE_FAST, S.MODE_SELECTIVE):
            part = rows.where((F.col("run_id") == run) & (F.col("system_name") == mode))
            sinks.append_events(part, 0, path, f"{run}-{mode}")
            if (run, mode) == ("run-b", S.MODE_FAST):
                sinks.append_events(part, 0, path, f"{run}-{mode}")
    rows.unpersist()
    now = sinks.current_events(spark, path, reports.SYSTEM_KEY)
    return rounded(now.select("run_id", F.col("epoch").cast("long").alias("epoch"), "system_name",
                              "is_anomaly", "p_final"), "p_final")


def repeated_table(spark, sf) -> str:
    """The decision table with every tenth row delivered twice."""
    path = scratch_path(spark, "repeated")
    rows = two_mode_events(spark, sf).persist()
    sinks.append_events(rows, 0, path)
    sinks.append_events(rows.where("epoch % 10 = 0"), 1, path)
    rows.unpersist()
    return path


@query("report_summary", sql(SQL_SUMMARY, f"""
select run_id, system_name, total, anomalies, uncertain, escalated, tp + fn as ground_truth_count,
  {s6('f1')}, {s6('escalation_rate')}, {s6('throughput_eps')} from z"""))
def _(spark, sf):
    out = reports.summary_report(spark, repeated_table(spark, sf))
    names = ["f1", "escalation_rate", "throughput_eps"]
    return rounded(out.select("run_id", "system_name", "total", "anomalies", "uncertain",
                              "escalated", "ground_truth_count", *names), *names)


@query("report_series", sql(SQL_RECORDS, series_sql(86400, 1800)))
def _(spark, sf):
    return reports.series_report(spark, repeated_table(spark, sf), "run-a", "selective")


@query("report_recent", sql(SQL_RECORDS, """
select event_id, epoch, prediction, engine from rec where system_name = 'selective'
order by processed_at_epoch_ms desc, event_id limit 100"""))
def _(spark, sf):
    out = reports.recent_report(spark, repeated_table(spark, sf), "run-a", "selective", 100)
    return out.select("event_id", "epoch", "prediction", "engine")


@query("run_status_without_rows", sql(SQL_RECORDS + """,
k as (select 'run-' || e.event_type as run, system_name, count(*) as total
  from rec join e on e.event_id = rec.seq where e.event_type <> 'click' group by 1, 2),
n as (select 'run-' || event_type as run, count(*) as planned from events group by event_type)""",
                                      """
select n.run as run_id, m.system_name, coalesce(total, 0) as total,
  cast(planned as bigint) as expected,
  case when n.run <> 'run-view' and coalesce(total, 0) >= planned then 'complete'
    else 'running' end as status
from n join (values ('fast'), ('selective')) m(system_name) on true
  left join k on k.run = n.run and k.system_name = m.system_name"""))
def _(spark, sf):
    """One registered run has no rows yet."""
    rows = runs_of_types(spark, sf).where("system_name <> 'external' and run_id <> 'run-click'")
    out = A.run_status(A.run_summary(rows), sinks.run_registry(run_updates(spark, sf)))
    return out.select("run_id", "system_name", "total", "expected", "status")


@query("latency_quantile_ranks", sql(SQL_RECORDS, """
select distinct run_id, system_name, true as p50_near, true as p95_near, true as p99_near
from rec"""))
def _(spark, sf):
    """Whether each approximate quantile lies within a hundredth of its rank."""
    rows = two_mode_events(spark, sf)
    marks = A.latency_quantiles(rows)
    x, n = F.col("processing_latency_ms"), F.count("*")
    def near(name: str, q: float):
        below, upto = F.count_if(x < F.col(name)) / n, F.count_if(x <= F.col(name)) / n
        return ((below <= q + 0.01) & (upto >= q - 0.01)).alias(name.replace("_ms", "_near"))
    return rows.join(marks, ["run_id", "system_name"]).groupBy("run_id", "system_name").agg(
        near("p50_ms", .5), near("p95_ms", .95), near("p99_ms", .99))


@query("column_append_values", sql(SQL_SCORED, "select seq, " + ", ".join(
    s6(c, f"x{i}") for i, c in enumerate([*S.FEATURES, "p_if", "p_ae"])) + " from g"))
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from sieveguard.detectors.fallback import column_append
    names = [f"x{i}" for i in range(12)]
    wide = column_append(scored(spark, sf)).withColumn("a", vector_to_array("inputs"))
    return rounded(wide.select("seq", *[F.col("a")[i].alias(n) for i, n in enumerate(names)]),
                   *names)


# Two example trees of three nodes (split on z of temperature, on temperature).
_NODES = [(0, 0, 6, .5, 1, 2, 0.), (0, 1, 0, 0., 1, 1, 3.), (0, 2, 0, 0., 2, 2, 1.5),
          (1, 0, 0, 50., 1, 2, 0.), (1, 1, 0, 0., 1, 1, 2.5), (1, 2, 0, 0., 2, 2, 1.)]


@query("isolation_forest_fixed_nodes", sql(SQL_SCORED, f"""
select seq, {s6('''5e-1 - pow(2e0, -(case when z_temp_15m < 5e-1 then 3e0 else 15e-1 end
  + case when temperature < 50 then 25e-1 else 1e0 end) / 2e0)''', 'if_score')} from g"""))
def _(spark, sf):
    nodes = spark.createDataFrame(_NODES, NODE_SCHEMA).withColumns(
        {"samples": F.lit(2), "offset": F.lit(-0.5)})
    out = score_forest(features(spark, sf), nodes).select("seq", "if_score")
    return rounded(out, "if_score")


@query("fallback_fixed_nodes", sql(SQL_SCORED, f"""
select seq, {s6('''case when uncertain then 1e0 / (1e0 + exp(-2e0 * (
  case when z_temp_15m <= 5e-1 then 3e0 else 15e-1 end
  + case when temperature <= 50 then 25e-1 else 1e0 end))) end''', 'p')} from g"""))
def _(spark, sf):
    nodes = spark.createDataFrame(_NODES, NODE_SCHEMA)
    out = score_fallback(scored(spark, sf).drop("p_fallback"), nodes, "p").select("seq", "p")
    return rounded(out, "p")


@query("isolation_forest_shape", """
select cast(t as int) as tree, true as binary_tree, true as leaves_closed, true as depth_bound,
  cast(least(512, (select count(*) from events)) as bigint) as samples
from range(100) r(t)""")
def _(spark, sf):
    """Properties of every fitted tree: twice its leaves less one, leaves that point at
    themselves, path lengths within the height, and its sample size."""
    nodes = fit_forest(features(spark, sf), unique="seq")
    leaf = F.col("left") == F.col("node")
    return nodes.groupBy("tree").agg(
        (F.count("*") == 2 * F.count_if(leaf) - 1).alias("binary_tree"),
        F.bool_and(~leaf | (F.col("right") == F.col("node"))).alias("leaves_closed"),
        F.bool_and(~leaf | (F.col("value") <= 9 + 12.0)).alias("depth_bound"),
        F.max("samples").cast("long").alias("samples"))
