"""Systems compared, escalation sweep, parity and decisions in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard.detectors.calibration import params_join, params_table
from sieveguard.detectors.fallback import batch_decide
from sieveguard.operators.aggregates import scaler_stats
from sieveguard.plans import evaluation as E
from sieveguard.scratch import scratch_path
from workload.base import (
    SQL_FEATURES, SQL_SCORED, features, mean_scores, query, rounded, s6, scored, sql)
from workload.reports import FAMILY_SQL

SQL_SYSTEMS = SQL_SCORED + f""",
sy as (
  select 'A' as system, p_if as p, g.* from g union all select 'B', p_ae, g.* from g
  union all select 'C', p_mean, g.* from g
  union all select 'D', case when uncertain then p_fallback else p_mean end, g.* from g
  union all select 'E', case when uncertain then 1e0 - p_if else p_mean end, g.* from g),
fam as (select *, {FAMILY_SQL} as family, p >= 5e-1 as hit from sy)"""


def systems(df):
    return E.system_scores(df, "p_fallback", 1.0 - F.col("p_if"))


@query("union_systems", sql(SQL_SYSTEMS, f"""
select system, {s6('p')}, label, anomaly_type, uncertain from sy"""))
def _(spark, sf):
    rows = scored(spark, sf)
    return rounded(E.union_systems(rows, systems(rows)), "p")


@query("evaluate_systems", sql(SQL_SYSTEMS + """,
c as (select system, count(*) as n, count(*) filter (label = 1 and hit) as tp,
    count(*) filter (label = 0 and hit) as fp, count(*) filter (label = 1 and not hit) as fn,
    count(*) filter (label = 0 and not hit) as tn, count(*) filter (uncertain) as up,
    coalesce(count(*) filter (hit and family = 'spikes')
      / nullif(cast(count(*) filter (family = 'spikes') as double), 0), 0e0) as spikes_recall,
    coalesce(count(*) filter (hit and family = 'drift')
      / nullif(cast(count(*) filter (family = 'drift') as double), 0), 0e0) as drift_recall,
    coalesce(count(*) filter (hit and family = 'flatline')
      / nullif(cast(count(*) filter (family = 'flatline') as double), 0), 0e0) as flatline_recall
  from fam group by system),
q as (select *, coalesce(tp / nullif(cast(tp + fp as double), 0), 0e0) as precision,
    coalesce(tp / nullif(cast(tp + fn as double), 0), 0e0) as recall,
    coalesce(fp / nullif(cast(fp + tn as double), 0), 0e0) as fpr from c),
gs as (select system, p, sum(label) as pos, sum(1 - label) as neg from sy group by 1, 2),
cum as (select *, sum(pos) over k as tp, sum(neg) over k as fp from gs
  window k as (partition by system order by p desc)),
ar as (select system, sum(neg * (tp - pos / 2e0)) / (cast(sum(pos) as double) * sum(neg)) as roc_auc,
    sum(pos * (tp / cast(tp + fp as double))) / sum(pos) as pr_auc from cum group by system)""", f"""
select q.system, {s6('precision')}, {s6('recall')},
  {s6('coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0)', 'f1')},
  {s6('pr_auc')}, {s6('roc_auc')}, {s6('fpr')}, {s6('spikes_recall')}, {s6('drift_recall')},
  {s6('flatline_recall')},
  {s6("case when q.system in ('A', 'B', 'C') then 0e0 else up * 1e2 / n end", 'escalation_pct')}
from q join ar on ar.system = q.system"""))
def _(spark, sf):
    rows = scored(spark, sf)
    out = E.evaluate_systems(rows, systems(rows))
    return rounded(out, *[c for c in out.columns if c != "system"])


SQL_SWEEP = SQL_SCORED + """,
o as (select *, row_number() over (order by uncertainty desc, seq) as place,
    count(*) over () as whole from g),
sw as (select rate, cast(round_even(rate * whole, 0) as bigint) as escalated, label,
    case when place <= round_even(rate * whole, 0) then p_fallback else p_mean end as p
  from o, (values (0e0), (25e-3), (5e-2), (1e-1), (2e-1), (4e-1), (1e0)) v(rate)),
c as (select rate, escalated, count(*) filter (label = 1 and p >= 5e-1) as tp,
    count(*) filter (label = 0 and p >= 5e-1) as fp, count(*) filter (label = 1 and p < 5e-1) as fn,
    count(*) filter (label = 0 and p < 5e-1) as tn from sw group by 1, 2)"""


@query("sweep_rates_join", sql(SQL_SWEEP, "select rate, escalated, tp, fp, fn, tn from c"))
def _(spark, sf):
    return E.sweep_rates_join(scored(spark, sf), unique="seq")


@query("escalation_sweep", sql(SQL_SWEEP + """,
q as (select *, coalesce(tp / nullif(cast(tp + fp as double), 0), 0e0) as precision,
    coalesce(tp / nullif(cast(tp + fn as double), 0), 0e0) as recall,
    coalesce(fp / nullif(cast(fp + tn as double), 0), 0e0) as fpr from c),
gs as (select rate, p, sum(label) as pos, sum(1 - label) as neg from sw group by 1, 2),
cum as (select *, sum(pos) over k as tp, sum(neg) over k as fp from gs
  window k as (partition by rate order by p desc)),
ar as (select rate, sum(pos * (tp / cast(tp + fp as double))) / sum(pos) as pr_auc
  from cum group by rate)""", f"""
select q.rate, escalated, {s6('precision')}, {s6('recall')},
  {s6('coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0)', 'f1')},
  {s6('pr_auc')}, {s6('fpr')} from q join ar on ar.rate = q.rate"""))
def _(spark, sf):
    out = E.escalation_sweep(scored(spark, sf), unique="seq")
    return rounded(out, "f1", "precision", "recall", "pr_auc", "fpr")


@query("capacity_estimate", sql(SQL_SCORED + """,
t as (select moteid, count(*) filter (uncertain) / cast(count(*) as double) as rate,
    10e0 + count(*) as fast_us, 5e0 + count(*) filter (label = 1) as fallback_us
  from g group by moteid)""", f"""
select moteid, {s6('fast_us + rate * fallback_us', 'service_us')}, 35000e0 as transport_capacity,
  {s6('least(35000e0, 1e6 / (fast_us + rate * fallback_us))', 'estimated_capacity')} from t"""))
def _(spark, sf):
    shares = scored(spark, sf).groupBy("moteid").agg(
        (F.count_if("uncertain") / F.count("*")).alias("rate"),
        (F.lit(10.0) + F.count("*")).alias("fast_us"),
        (F.lit(5.0) + F.count_if(F.col("label") == 1)).alias("fallback_us"))
    out = E.capacity_estimate(shares)
    return rounded(out.select("moteid", "service_us", "transport_capacity", "estimated_capacity"),
                   "service_us", "estimated_capacity")


@query("parity_check", sql(SQL_SCORED, """
select 'run-a:' || cast(seq as varchar) as event_id,
  case when anomaly_type = 'FLATLINE' then 'missing' when anomaly_type = 'DRIFT' then 'score'
    else 'flag' end as problem
from g where anomaly_type in ('FLATLINE', 'DRIFT')
  or (anomaly_type = 'SPIKE_TEMP' and uncertain)"""))
def _(spark, sf):
    a = mean_scores(spark, sf).withColumn("escalated", F.col("uncertain")).select(
        "event_id", "p_if", "p_ae", "p_final", "escalated", "anomaly_type")
    kind = F.col("anomaly_type")
    b = a.where(kind != "FLATLINE").withColumns({
        "p_ae": F.col("p_ae") + F.when(kind == "DRIFT", 2e-5).otherwise(1e-6),
        "escalated": (kind != "SPIKE_TEMP") & F.col("escalated")})
    return E.parity_check(a, b).select("event_id", "problem")


@query("batch_decide", sql(SQL_SCORED + """,
h as (select seq, moteid, epoch, 1e0 / (1e0 + exp(-greatest(-15e0, least(15e0, 18e-1 * p_if
    + 2e0 * p_ae + 7e-1 * (abs(z_temp_15m) + abs(z_volt_15m)) + 12e-1 * (abs(temp_slope_15m)
    + abs(delta_temp_3m)) + 5e-1 * abs(p_if - p_ae) - 22e-1)))) as p from g)""", f"""
select seq, moteid, epoch, case when p >= 5e-1 then 'ANOMALY' else 'NORMAL' end as decision,
  {s6('p', 'p_anomaly')} from h"""))
def _(spark, sf):
    out = batch_decide(scored(spark, sf), "heuristic")
    return rounded(out.select("seq", "moteid", "epoch", "decision", "p_anomaly"), "p_anomaly")


@query("params_join", sql(SQL_FEATURES + ",\nst as (" + "\nunion all\n".join(
    f"select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) + 1e-4 as std from f"
    for c in ("temperature", "voltage")) + """),
lg as (select seq, 'temperature' as feature, temperature as value from f
  union all select seq, 'voltage', voltage from f)""", f"""
select seq, lg.feature, {s6('(value - mean) / std', 'scaled')}
from lg join st on st.feature = lg.feature"""))
def _(spark, sf):
    rows = features(spark, sf)
    packed = F.collect_list(F.struct("feature", "mean", "std"))  # ten rows
    one = scaler_stats(rows).agg(packed.alias("s")).select(
        F.lit(1.0).alias("coef"), F.lit(0.0).alias("intercept"), F.col("s.mean").alias("means"),
        F.col("s.std").alias("stds"), F.col("s.feature").alias("features"))
    path = scratch_path(spark, "calibration")
    one.write.json(path)
    long = rows.select("seq", F.expr(
        "stack(2, 'temperature', temperature, 'voltage', voltage) as (feature, value)"))
    out = params_join(long, params_table(spark, path, "reconstruction"))
    return out.select("seq", "feature", ((F.col("value") - F.col("mean")) / F.col("std"))
                      .alias("scaled")).withColumn("scaled", F.round(F.col("scaled") + 1.83e-7, 6))
