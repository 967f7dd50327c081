"""Summaries, quality, series and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard.functions.columns import filter_events
from sieveguard.operators import aggregates as A
from sieveguard.operators import ranking, topk
from sieveguard.sources.sinks import event_rows, run_registry
from workload.base import (
    ORDER, SQL_FEATURES, SQL_READINGS, SQL_RECORDS, SQL_SCORED, features, query, readings,
    records, rounded, s6, scored, sql, two_mode_events)

SQL_SUMMARY = SQL_RECORDS + """,
s as (select run_id, system_name, count(*) as total,
    count(*) filter (is_anomaly = 1) as anomalies, count(*) filter (uncertain) as uncertain,
    count(*) filter (escalated) as escalated,
    count(*) filter (label = 1 and is_anomaly = 1) as tp,
    count(*) filter (label = 0 and is_anomaly = 1) as fp,
    count(*) filter (label = 1 and is_anomaly = 0) as fn,
    count(*) filter (label = 0 and is_anomaly = 0) as tn,
    min(processed_at_epoch_ms) as first_ms, max(processed_at_epoch_ms) as last_ms,
    quantile_cont(processing_latency_ms, 5e-1) as p50_ms,
    quantile_cont(processing_latency_ms, 95e-2) as p95_ms,
    quantile_cont(processing_latency_ms, 99e-2) as p99_ms
  from rec group by run_id, system_name),
q as (select *, tp / nullif(cast(tp + fp as double), 0) as precision,
    tp / nullif(cast(tp + fn as double), 0) as recall,
    fp / nullif(cast(fp + tn as double), 0) as fpr from s),
z as (select *, 2e0 * precision * recall / nullif(precision + recall, 0e0) as f1,
    case when total > 1 and last_ms > first_ms
      then round(total / ((last_ms - first_ms) / 1e3), 2) else 0e0 end as throughput_eps,
    coalesce(cast(escalated as double) / nullif(total, 0), 0e0) as escalation_rate from q)"""


@query("run_summary", sql(SQL_SUMMARY, """
select run_id, system_name, total, anomalies, uncertain, escalated, tp, fp, fn, tn, first_ms,
  last_ms from s"""))
def _(spark, sf):
    return A.run_summary(two_mode_events(spark, sf))


def flagship(spark, sf):
    """Counts, quality and escalation of both modes."""
    out = A.escalation_rate(A.detection_metrics(A.run_summary(two_mode_events(spark, sf))))
    return rounded(out, "precision", "recall", "f1", "fpr", "escalation_rate")


@query("flagship", sql(SQL_SUMMARY, f"""
select run_id, system_name, total, anomalies, uncertain, escalated, tp, fp, fn, tn, first_ms,
  last_ms, {s6('precision')}, {s6('recall')}, {s6('f1')}, {s6('fpr')}, {s6('escalation_rate')}
from z"""))
def _(spark, sf):
    return flagship(spark, sf)


@query("latency_quantiles")
def _(spark, sf):
    return A.latency_quantiles(two_mode_events(spark, sf))


@query("latency_quantiles_exact", sql(SQL_SUMMARY, f"""
select run_id, system_name, {s6('p50_ms')}, {s6('p95_ms')}, {s6('p99_ms')} from s"""))
def _(spark, sf):
    out = A.latency_quantiles(two_mode_events(spark, sf), exact=True)
    return rounded(out, "p50_ms", "p95_ms", "p99_ms")


@query("detection_metrics", sql(SQL_RECORDS + """,
c as (select moteid, count(*) filter (label = 1 and is_anomaly = 1) as tp,
    count(*) filter (label = 0 and is_anomaly = 1) as fp,
    count(*) filter (label = 1 and is_anomaly = 0) as fn,
    count(*) filter (label = 0 and is_anomaly = 0) as tn
  from rec where system_name = 'selective' group by moteid),
q as (select *, tp / nullif(cast(tp + fp as double), 0) as precision,
    tp / nullif(cast(tp + fn as double), 0) as recall,
    fp / nullif(cast(fp + tn as double), 0) as fpr from c)""", f"""
select moteid, {s6('precision')}, {s6('recall')}, {s6('fpr')},
  {s6('2e0 * precision * recall / nullif(precision + recall, 0e0)', 'f1')},
  {s6('coalesce(precision, 0e0)', 'precision_or_zero')} from q"""))
def _(spark, sf):
    cells = A.confusion_matrix(records(spark, sf), ["moteid"])
    null = A.detection_metrics(cells)
    out = null.withColumn("precision_or_zero", F.coalesce("precision", F.lit(0.0)))
    names = ["precision", "recall", "fpr", "f1", "precision_or_zero"]
    return rounded(out.select("moteid", *names), *names)


@query("throughput", sql(SQL_SUMMARY, f"""
select run_id, system_name, {s6('throughput_eps')} from z"""))
def _(spark, sf):
    out = A.throughput(A.run_summary(two_mode_events(spark, sf)))
    return rounded(out.select("run_id", "system_name", "throughput_eps"), "throughput_eps")


@query("escalation_rate", sql(SQL_SUMMARY, f"""
select run_id, system_name, {s6('escalation_rate')} from z"""))
def _(spark, sf):
    out = A.escalation_rate(A.run_summary(two_mode_events(spark, sf)))
    return rounded(out.select("run_id", "system_name", "escalation_rate"), "escalation_rate")


def runs_of_types(spark, sf):
    """One run per event type over all three systems, the external one on uncertain rows."""
    kinds = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("epoch"), F.concat(F.lit("run-"), "event_type").alias("run"))
    rows = two_mode_events(spark, sf).join(kinds, "epoch").withColumn("run_id", F.col("run"))
    external = rows.where("system_name = 'fast' and uncertain = 1").withColumns(
        {"system_name": F.lit("external"), "escalated": F.lit(1)})
    return rows.unionByName(external).drop("run")


@query("run_status", sql(SQL_RECORDS + """,
k as (select rec.*, 'run-' || e.event_type as run from rec join e on e.event_id = rec.seq),
u as (select run, system_name, uncertain from k
  union all select run, 'external', uncertain from k where system_name = 'fast' and uncertain),
s as (select run, system_name, count(*) as total, count(*) filter (uncertain) as uncertain
  from u group by run, system_name),
o as (select run, sum(uncertain) filter (system_name <> 'external') as open from s group by run),
n as (select 'run-' || event_type as run, count(*) as planned from events group by event_type)""",
                     """
select s.run as run_id, s.system_name, total,
  cast(case when s.system_name = 'external' then open else planned end as bigint) as expected,
  case when s.system_name = 'external' and s.run <> 'run-error' then 'disabled'
    when s.run <> 'run-view'
      and total >= case when s.system_name = 'external' then open else planned end then 'complete'
    else 'running' end as status
from s join o on o.run = s.run join n on n.run = s.run"""))
def _(spark, sf):
    from workload.tables import run_updates
    summary = A.run_summary(runs_of_types(spark, sf))
    out = A.run_status(summary, run_registry(run_updates(spark, sf)))
    return out.select("run_id", "system_name", "total", "expected", "status")


@query("run_meta_join", sql(SQL_RECORDS + """,
k as (select 'run-' || e.event_type as run_id, rec.event_id from rec
  join e on e.event_id = rec.seq where system_name = 'selective'),
n as (select 'run-' || event_type as run_id, count(*) as planned from events group by event_type)""",
                        """
select k.run_id, k.event_id, planned as expected_count from k left join n on n.run_id = k.run_id"""))
def _(spark, sf):
    from workload.tables import run_updates
    runs = run_registry(run_updates(spark, sf)).select("run_id", "expected_count")
    events = runs_of_types(spark, sf).where("system_name = 'selective'")
    return events.join(runs, "run_id", "left").select("run_id", "event_id", "expected_count")


def series_sql(span, bucket):
    return f"""
select cast(processed_at_epoch_ms // {bucket * 1000} * {bucket * 1000} as bigint) as bucket_ms,
  count(*) as readings, count(*) filter (is_anomaly = 1) as anomalies,
  count(*) filter (escalated) as escalated
from rec where system_name = 'selective'
  and processed_at_epoch_ms >= (select max(processed_at_epoch_ms) - {span * 1000} from rec)
group by 1"""


@query("event_series_24h", sql(SQL_RECORDS, series_sql(86400, 1800)))
def _(spark, sf):
    return A.event_series(two_mode_events(spark, sf), "run-a", "selective", "24h")


@query("event_series_6h", sql(SQL_RECORDS, series_sql(21600, 300)))
def _(spark, sf):
    return A.event_series(two_mode_events(spark, sf), "run-a", "selective", "6h")


@query("event_series_1h", sql(SQL_RECORDS, series_sql(3600, 60)))
def _(spark, sf):
    return A.event_series(two_mode_events(spark, sf), "run-a", "selective", "1h")


@query("series_window_bound", sql(SQL_RECORDS, """
select max(processed_at_epoch_ms) as last_ms from rec where run_id = 'run-a'"""))
def _(spark, sf):
    return A.series_bound(two_mode_events(spark, sf), "run-a")


@query("confusion_matrix", sql(SQL_SUMMARY, "select system_name, tp, fp, fn, tn from s"))
def _(spark, sf):
    return A.confusion_matrix(two_mode_events(spark, sf), ["system_name"])


SQL_RANKED = SQL_RECORDS + """,
gs as (select system_name, p_final as score, sum(label) as pos, sum(1 - label) as neg
  from rec group by 1, 2),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp from gs
  window w as (partition by system_name order by score desc))"""


@query("roc_auc", sql(SQL_RANKED, f"""
select system_name, {s6('sum(neg * (tp - pos / 2e0)) / (cast(sum(pos) as double) * sum(neg))',
                        'roc_auc')} from cum group by system_name"""))
def _(spark, sf):
    out = ranking.roc_auc(two_mode_events(spark, sf), ["system_name"], label="ground_truth")
    return rounded(out, "roc_auc")


@query("average_precision", sql(SQL_RANKED, f"""
select system_name, {s6('sum(pos * (tp / cast(tp + fp as double))) / sum(pos)', 'pr_auc')}
from cum group by system_name"""))
def _(spark, sf):
    out = ranking.average_precision(two_mode_events(spark, sf), ["system_name"],
                                    label="ground_truth")
    return rounded(out, "pr_auc")


FAMILY_SQL = """case when anomaly_type in ('SPIKE_TEMP', 'SPIKE_VOLT_DROP') then 'spikes'
  when anomaly_type = 'DRIFT' then 'drift' when anomaly_type = 'FLATLINE' then 'flatline' end"""


@query("recall_by_family", sql(SQL_RECORDS, f"""
select system_name, {FAMILY_SQL} as family, count(*) as total,
  count(*) filter (is_anomaly = 1) as caught,
  {s6('count(*) filter (is_anomaly = 1) / cast(count(*) as double)', 'recall')}
from rec where anomaly_type <> 'NORMAL' group by 1, 2"""))
def _(spark, sf):
    return rounded(A.recall_by_family(two_mode_events(spark, sf), ["system_name"]), "recall")


@query("recall_by_type", sql(SQL_RECORDS, f"""
select anomaly_type, count(*) as total, count(*) filter (is_anomaly = 1) as caught,
  {s6('count(*) filter (is_anomaly = 1) / cast(count(*) as double)', 'recall')}
from rec where anomaly_type <> 'NORMAL' and system_name = 'selective' group by 1"""))
def _(spark, sf):
    return rounded(A.recall_by_family(records(spark, sf), families=False), "recall")


@query("type_breakdown", sql(SQL_READINGS, f"""
select anomaly_type, count(*) as n,
  {s6('count(*) * 1e2 / (select count(*) from r)', 'pct')} from r group by 1"""))
def _(spark, sf):
    return rounded(A.type_breakdown(readings(spark, sf)), "pct")


@query("prevalence", sql(SQL_READINGS, f"""
select moteid, count(*) as n, cast(sum(label) as bigint) as positives,
  {s6('avg(label)', 'prevalence')} from r group by 1"""))
def _(spark, sf):
    return rounded(A.prevalence(readings(spark, sf), ["moteid"]), "prevalence")


@query("gate_statistics", sql(SQL_SCORED, f"""
select count(*) filter (uncertain) as escalated, count(*) filter (not uncertain) as confident,
  {s6('count(*) filter (uncertain) * 1e2 / count(*)', 'escalated_pct')},
  {s6('count(*) filter (not uncertain) * 1e2 / count(*)', 'confident_pct')},
  count(*) filter (uncertain and label = 1) as anomalies_in_uncertain,
  count(*) filter (label = 1) as anomalies from g"""))
def _(spark, sf):
    return rounded(A.gate_statistics(scored(spark, sf)), "escalated_pct", "confident_pct")


@query("classification_report", sql(SQL_SUMMARY + """,
b as (select tp, fp, fn, tn from s where system_name = 'selective'),
c as (select 'NORMAL' as class, tn as hit, fn as wrong, fp as missed, tn + fp as support from b
  union all select 'ANOMALY', tp, fp, fn, tp + fn from b),
d as (select class, hit, support, coalesce(hit / nullif(cast(hit + wrong as double), 0), 0e0) as p,
    coalesce(hit / nullif(cast(hit + missed as double), 0), 0e0) as rc from c),
h as (select *, coalesce(2 * p * rc / nullif(p + rc, 0e0), 0e0) as f from d),
a as (select class, p, rc, f, support from h
  union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support),
    sum(hit) / sum(support), sum(support) from h
  union all select 'macro avg', avg(p), avg(rc), avg(f), sum(support) from h
  union all select 'weighted avg', sum(p * support) / sum(support),
    sum(rc * support) / sum(support), sum(f * support) / sum(support), sum(support) from h)""", f"""
select class, {s6('p', 'precision')}, {s6('rc', 'recall')}, {s6('f', 'f1')},
  cast(support as bigint) as support from a"""))
def _(spark, sf):
    return rounded(A.classification_report(records(spark, sf)), "precision", "recall", "f1")


@query("feature_scaler_stats", sql(SQL_FEATURES, "\nunion all\n".join(
    f"select '{c}' as feature, {s6(f'avg({c})', 'mean')}, "
    f"{s6(f'stddev_pop({c}) + 1e-4', 'std')} from f" for c in A.S.FEATURES)))
def _(spark, sf):
    return rounded(A.scaler_stats(features(spark, sf)), "mean", "std")


@query("class_balance_weight", sql(SQL_READINGS + """,
c as (select count(*) as n, cast(sum(label) as bigint) as pos from r)""", f"""
select n, pos, n - pos as neg, {s6('n / (2e0 * (n - pos))', 'weight_normal')},
  {s6('n / (2e0 * pos)', 'weight_anomaly')},
  {s6('greatest(1e0, (n - pos) / (pos + 1e-4))', 'scale_pos_weight')} from c"""))
def _(spark, sf):
    return rounded(A.class_weights(readings(spark, sf)), "weight_normal", "weight_anomaly",
                   "scale_pos_weight")


@query("error_profile", sql(SQL_SCORED, f"""
select {s6('avg(z_temp_15m * z_temp_15m)', 'mean_error')},
  {s6('quantile_cont(z_temp_15m * z_temp_15m, 95e-2)', 'p95_error')} from g"""))
def _(spark, sf):
    errors = scored(spark, sf).select((F.col("z_temp_15m") * F.col("z_temp_15m")).alias("err"))
    return rounded(A.error_profile(errors, "err"), "mean_error", "p95_error")


@query("mode_comparison", sql(SQL_SUMMARY, f"""
select run_id, system_name as "mode", total as events, {s6('f1')}, {s6('precision')},
  {s6('recall')}, {s6('fpr')}, {s6('escalation_rate')},
  {s6('throughput_eps', 'throughput_events_per_second')}, {s6('p50_ms', 'latency_p50_ms')},
  {s6('p95_ms', 'latency_p95_ms')}, {s6('p99_ms', 'latency_p99_ms')} from z"""))
def _(spark, sf):
    out = A.mode_comparison(two_mode_events(spark, sf), exact=True)
    return rounded(out, *[c for c in out.columns if c not in ("run_id", "mode", "events")])


@query("recent_events", sql(SQL_RECORDS, f"""
select run_id, event_id, substr(replace("timestamp", 'T', ' '), 1, 23) as "timestamp", moteid,
  epoch, temperature, humidity, light, voltage, label as ground_truth, prediction, is_anomaly,
  {s6('p_if')}, {s6('p_ae')}, {s6('p_final')}, case when escalated then 1 else 0 end as escalated,
  engine, inference_status, anomaly_reasons, processing_latency_ms
from rec where system_name = 'selective' order by processed_at_epoch_ms desc, event_id limit 100"""))
def _(spark, sf):
    chosen = filter_events(event_rows(records(spark, sf)), "run-a", "selective")
    return rounded(topk.recent_events(chosen, 100), "p_if", "p_ae", "p_final")


@query("attention_list", sql(SQL_RECORDS + """,
t as (select * from rec where system_name = 'selective'
  order by processed_at_epoch_ms desc, event_id limit 250)""", """
select event_id, case when moteid < 10 then '0' || cast(moteid as varchar)
    else cast(moteid as varchar) end as mote,
  replace(anomaly_reasons, '_', ' ') as display_type,
  case when is_anomaly = 1 then 'HIGH' else 'REVIEW' end as severity
from t where is_anomaly = 1 or escalated order by processed_at_epoch_ms desc, event_id limit 3"""))
def _(spark, sf):
    chosen = filter_events(event_rows(records(spark, sf)), "run-a", "selective")
    ranked = chosen.orderBy(*topk.sort_columns(topk.NEWEST)).limit(250)
    return topk.attention_list(ranked)


@query("head_n", sql(SQL_READINGS, """
select seq, moteid from r order by ts, seq limit (select 2 * count(*) // 3 from r)"""))
def _(spark, sf):
    rows = readings(spark, sf)
    return topk.take_first(rows, ORDER, 2 * rows.count() // 3, sort_limit=100).select(
        "seq", "moteid")


@query("chronological_sort", sql(SQL_READINGS, "select seq, ts from r"))
def _(spark, sf):
    return topk.chronological_sort(readings(spark, sf), ORDER).select("seq", "ts")


@query("escalation_topk", sql(SQL_SCORED + """,
o as (select *, row_number() over (order by uncertainty desc, seq) as place,
    count(*) over () as whole from g)""", """
select rate, count(*) as escalated, cast(sum(seq) as bigint) as seqs,
  cast(sum(label) as bigint) as labels
from o join (values (25e-3), (5e-2), (1e-1), (2e-1), (4e-1), (1e0)) v(rate)
  on place <= round_even(rate * whole, 0) group by rate"""))
def _(spark, sf):
    rows = scored(spark, sf)
    out = topk.escalation_topk(rows, unique="seq")
    return out.groupBy("rate").agg(F.count("*").alias("escalated"), F.sum("seq").alias("seqs"),
                                   F.sum("label").alias("labels"))
