"""Splits, injected anomalies and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard.operators import prepare as P
from sieveguard.operators.ordering import ordered_sequence
from workload.base import ORDER, SQL_READINGS, query, readings, rounded, s6, sql

SEED = 42

SQL_SPLIT = SQL_READINGS + """,
o as (select *, row_number() over (order by ts, seq) - 1 as pos, count(*) over () as size from r),
sp as (select *, case when pos < floor(size * 6e-1) then 'train'
    when pos < floor(size * (6e-1 + 2e-1)) then 'val' else 'test' end as split from o)"""


def mixed(x: str, stream: int) -> str:
    """The mixed position of SQL: the same integer steps as in the operator."""
    start = f"({x} * 7919 + {SEED * 104729 + stream * 15485863})"
    once = f"({start} % 2147483647 * 48271 % 2147483647)"
    return f"({once} * {once} % 2147483647)"


def uni(x: str, stream: int) -> str:
    return f"({mixed(x, stream)} / 2147483647e0)"


SQL_POSITIONS = SQL_READINGS + """,
o as (select *, row_number() over (order by ts, seq) - 1 as pos, count(*) over () as size from r)"""

SQL_SPIKES = SQL_POSITIONS + f""",
dr as (select *, row_number() over (order by {mixed('pos', 0)}, pos) as draw from o),
sk as (select *, draw <= floor(size * 12e-3) as hit, {uni('pos', 1)} > 5e-1 as hot from dr),
s1 as (select * exclude (temperature, voltage),
    case when hit and hot then temperature + (8e0 + 12e0 * {uni('pos', 2)})
      * case when {uni('pos', 3)} > 3e-1 then 1e0 else -1e0 end else temperature end as temperature,
    case when hit and not hot then greatest(18e-1, voltage - (4e-1 + 5e-1 * {uni('pos', 4)}))
      else voltage end as voltage,
    case when hit then case when hot then 'SPIKE_TEMP' else 'SPIKE_VOLT_DROP' end end as spike_type
  from sk)"""


def plan_sql(name: str, share: str, length: int, stream: int, tail: int, short: int, long: int
             ) -> str:
    return f""",
{name}_b as (select b, (select count(*) from r) as size from range(0, cast(
    (select floor(count(*) * {share} / {length}e0) from r) as bigint)) t(b)),
{name} as (select b, cast(100 + floor({uni('b', stream)} * (size - {tail + 100})) as bigint) as start,
    cast({short} + floor({uni('b', stream + 1)} * {long - short}) as bigint) as len,
    2e-1 + 3e-1 * {uni('b', stream + 2)} as slope from {name}_b)"""


def drift_sql(source: str, share: str = "1e-2") -> str:
    return plan_sql("dp", share, 40, 10, 60, 25, 45) + f""",
rise as (select pos, sum((pos - start) * slope) as up from {source} join dp
  on pos >= start and pos < start + len group by pos),
s2 as (select {source}.* exclude (temperature), temperature + coalesce(up, 0e0) as temperature,
    case when up is not null then 'DRIFT' end as drift_type
  from {source} left join rise on rise.pos = {source}.pos)"""


def flat_sql(source: str, share: str = "8e-3") -> str:
    return plan_sql("fp", share, 25, 20, 40, 15, 30) + f""",
par as (select c.b, max(a.b) as up from fp c join fp a
  on a.b < c.b and c.start >= a.start and c.start < a.start + a.len group by c.b),
chain as (with recursive walk as (
    select b, b as root from fp
    union all select walk.b, par.up from walk join par on par.b = walk.root)
  select b, min(root) as root from walk group by b),
held as (select fp.b, {source}.temperature as ht, {source}.voltage as hv
  from chain join fp on fp.b = chain.b join fp q on q.b = chain.root
  join {source} on {source}.pos = q.start),
own as (select pos, max(b) as b from {source} join fp on pos >= start and pos < start + len
  group by pos),
s3 as (select {source}.* exclude (temperature, voltage), coalesce(ht, temperature) as temperature,
    coalesce(hv, voltage) as voltage, case when own.b is not null then 'FLATLINE' end as flat_type
  from {source} left join own on own.pos = {source}.pos left join held on held.b = own.b)"""


@query("chronological_split", sql(SQL_SPLIT, "select seq, split from sp"))
def _(spark, sf):
    return P.chronological_split(readings(spark, sf), order=ORDER).select("seq", "split")


@query("inject_spikes", sql(SQL_SPIKES, f"""
select seq, {s6('temperature')}, {s6('voltage')}, spike_type from s1"""))
def _(spark, sf):
    out = P.inject_spikes(readings(spark, sf), order=ORDER, seed=SEED)
    return rounded(out.select("seq", "temperature", "voltage", "spike_type"),
                   "temperature", "voltage")


@query("inject_drift", sql(SQL_POSITIONS + drift_sql("o", "2e-1"), f"""
select seq, {s6('temperature')}, drift_type from s2"""))
def _(spark, sf):
    out = P.inject_drift(readings(spark, sf), 0.2, SEED, order=ORDER)
    return rounded(out.select("seq", "temperature", "drift_type"), "temperature")


@query("inject_flatline", sql(SQL_POSITIONS + flat_sql("o", "3e-1"), """
select seq, temperature, voltage, flat_type from s3"""))
def _(spark, sf):
    return P.inject_flatline(readings(spark, sf), 0.3, SEED, order=ORDER).select(
        "seq", "temperature", "voltage", "flat_type")


SQL_INJECTED = (SQL_SPIKES + drift_sql("s1") + flat_sql("s2") + """,
inj as (select * exclude (label, anomaly_type),
    coalesce(flat_type, drift_type, spike_type, 'NORMAL') as anomaly_type,
    case when coalesce(flat_type, drift_type, spike_type) is null then 0 else 1 end as label
  from s3)""")


@query("inject_anomalies", sql(SQL_INJECTED, f"""
select seq, {s6('temperature')}, {s6('voltage')}, label, anomaly_type from inj"""))
def _(spark, sf):
    out = P.inject_anomalies(readings(spark, sf), SEED, order=ORDER)
    return rounded(out.select("seq", "temperature", "voltage", "label", "anomaly_type"),
                   "temperature", "voltage")


@query("anomaly_label", sql(SQL_INJECTED, """
select anomaly_type, count(*) as n, cast(sum(label) as bigint) as labels from inj group by 1"""))
def _(spark, sf):
    out = P.inject_anomalies(readings(spark, sf), SEED, order=ORDER)
    return out.groupBy("anomaly_type").agg(F.count("*").alias("n"),
                                           F.sum("label").alias("labels"))


@query("inject_anomalies_per_sensor")
def _(spark, sf):
    """Blocks run inside one sensor; the rates are high because each sensor is short."""
    out = P.inject_anomalies(readings(spark, sf), SEED, drift=0.8, flatline=0.6, scope="sensor",
                             order=ORDER)
    return out.select("seq", "moteid", "temperature", "voltage", "label", "anomaly_type")


@query("injection_range_join", sql(SQL_POSITIONS + plan_sql("dp", "1e-1", 40, 10, 60, 25, 45), """
select seq, b as block, pos - start as step from o join dp
  on pos >= start and pos < start + len"""))
def _(spark, sf):
    rows = ordered_sequence(readings(spark, sf), ORDER)
    sizes = rows.groupBy().agg(F.count("*").alias("_size"))
    plan = P.block_plan(sizes, 0.1, seed=SEED, **P.DRIFT)
    return P.injection_range_join(rows, plan, "pos").select("seq", "block", "step")


@query("split_bounds", sql(SQL_SPLIT, """
select split, count(*) as n, min(ts) as min_ts, max(ts) as max_ts from sp group by 1"""))
def _(spark, sf):
    return P.split_bounds(P.chronological_split(readings(spark, sf), order=ORDER))


@query("leakage_audit", sql(SQL_SPLIT + """,
b as (select split, min(ts) as lo, max(ts) as hi from sp group by 1)""", """
select x.split as earlier, y.split as later, x.hi as max_earlier, y.lo as min_later,
  x.hi <= y.lo as passed
from b x join b y on (x.split = 'train' and y.split = 'val')
  or (x.split = 'val' and y.split = 'test')"""))
def _(spark, sf):
    return P.leakage_audit(P.chronological_split(readings(spark, sf), order=ORDER))


@query("clean_train_check", sql(SQL_SPLIT, """
select count(*) as n, cast(sum(label) as bigint) as labels,
  count(*) filter (anomaly_type <> 'NORMAL') as not_normal,
  sum(label) = 0 and count(*) filter (anomaly_type <> 'NORMAL') = 0 as passed
from sp where split = 'train'"""))
def _(spark, sf):
    return P.clean_train_check(P.chronological_split(readings(spark, sf), order=ORDER))


@query("prevalence_check", sql(SQL_SPLIT, f"""
select split, {s6('avg(label)', 'prevalence')}, avg(label) between 2e-2 and 4e-2 as passed
from sp where split <> 'train' group by 1"""))
def _(spark, sf):
    split = P.chronological_split(readings(spark, sf), order=ORDER)
    return rounded(P.prevalence_check(split), "prevalence")
