"""Projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.fallback import selective_override
from sieveguard.functions import columns as C
from workload.base import (
    SQL_FEATURES, SQL_READINGS, SQL_RECORDS, SQL_SCORED, WEIGHTS, features, probabilities, query,
    r6, readings, records, rounded, s6, scored, sql, two_mode_events, two_mode_records)


@query("default_identity", sql(SQL_READINGS + """,
b as (select moteid, epoch, seq,
    case when anomaly_type = 'DRIFT' then '  ' when anomaly_type = 'NORMAL' then run_id end as run_id,
    case when label = 1 then null else event_id end as event_id,
    case when anomaly_type = 'FLATLINE' then 0 else sent_at_epoch_ms end as sent_at_epoch_ms
  from r),
i as (select *, case when trim(coalesce(run_id, '')) = '' then 'manual' else run_id end as run
  from b)""", """
select seq, run as run_id, coalesce(event_id, run || ':' || cast(moteid as varchar) || ':'
    || cast(epoch as varchar)) as event_id,
  case when sent_at_epoch_ms <= 0 then 1700000000000 else sent_at_epoch_ms end as sent_at_epoch_ms
from i"""))
def _(spark, sf):
    kind = F.col("anomaly_type")
    rows = readings(spark, sf).withColumns({
        "run_id": F.when(kind == "DRIFT", "  ").when(kind == "NORMAL", F.col("run_id")),
        "event_id": F.when(F.col("label") == 0, F.col("event_id")),
        "sent_at_epoch_ms": F.when(kind == "FLATLINE", F.lit(0).cast("long"))
        .otherwise(F.col("sent_at_epoch_ms"))})
    return C.default_identity(rows, 1_700_000_000_000).select(
        "seq", "run_id", "event_id", "sent_at_epoch_ms")


_DIRTY = ["temperature", "delta_temp_3m", "z_temp_15m"]


@query("clean_features", sql(SQL_FEATURES, f"""
select seq, case when label = 1 then 0e0 else temperature end as temperature,
  {s6("case when anomaly_type = 'DRIFT' then 0e0 else delta_temp_3m end", 'delta_temp_3m')},
  {s6("case when anomaly_type = 'FLATLINE' then 0e0 else z_temp_15m end", 'z_temp_15m')}
from f"""))
def _(spark, sf):
    kind = F.col("anomaly_type")
    dirty = features(spark, sf).withColumns({
        "temperature": F.when(F.col("label") == 0, F.col("temperature")),
        "delta_temp_3m": F.when(kind == "DRIFT", float("nan")).otherwise(F.col("delta_temp_3m")),
        "z_temp_15m": F.when(kind == "FLATLINE", float("-inf")).otherwise(F.col("z_temp_15m"))})
    return rounded(C.clean_features(dirty).select("seq", *_DIRTY), *_DIRTY[1:])


# An example scaler.
MEANS = [20.0, 40.0, 250.0, 2.5, 0.0, 0.0, -0.5, 0.0, 0.0, 100.0]
STDS = [3.0, 7.0, 500.0, 0.1, 0.3, 0.01, 1.4, 1.0, 0.05, 3.5]


@query("standardize", sql(SQL_FEATURES, "select seq, " + ", ".join(
    s6(f"({c} - {m:e}) / {s:e}", f"std_{c}") for c, m, s in zip(S.FEATURES, MEANS, STDS))
    + " from f"))
def _(spark, sf):
    out = C.standardize(features(spark, sf), MEANS, STDS)
    names = [f"std_{c}" for c in S.FEATURES]
    return rounded(out.select("seq", *names), *names)


@query("calibrated_prob", sql(SQL_SCORED, f"select seq, {s6('p_if')}, {s6('p_ae')} from g"))
def _(spark, sf):
    return rounded(probabilities(features(spark, sf)).select("seq", "p_if", "p_ae"),
                   "p_if", "p_ae")


@query("ensemble_mean", sql(SQL_SCORED, f"""
select seq, {s6('p_mean')}, p_mean >= 5e-1 as hit from g"""))
def _(spark, sf):
    out = probabilities(features(spark, sf)).select("seq", C.ensemble_mean().alias("p_mean"))
    return rounded(out.withColumn("hit", F.col("p_mean") >= 0.5), "p_mean")


@query("uncertainty_gate", sql(SQL_SCORED, "select seq, disagreement, uncertain from g"))
def _(spark, sf):
    return C.uncertainty_gate(probabilities(features(spark, sf))).select(
        "seq", "disagreement", "uncertain")


@query("uncertainty_score", sql(SQL_SCORED, f"select seq, {s6('uncertainty')} from g"))
def _(spark, sf):
    out = probabilities(features(spark, sf))
    return out.select("seq", r6(C.uncertainty_score()).alias("uncertainty"))


@query("selective_override", sql(SQL_RECORDS, f"""
select seq, system_name, uncertain, escalated, {s6('p_final')} from rec"""))
def _(spark, sf):
    gated = C.uncertainty_gate(probabilities(features(spark, sf)))
    out = [selective_override(gated, C.heuristic_prob(WEIGHTS), mode).select(
        "seq", F.lit(mode).alias("system_name"), "uncertain", "escalated", "p_final")
        for mode in ("fast", "selective")]
    return rounded(out[0].unionByName(out[1]), "p_final")


@query("selective_override_batch_model", sql(SQL_RECORDS, f"""
select seq, escalated, {s6('p_final')} from rec where system_name = 'selective'"""))
def _(spark, sf):
    """The stronger model as a batch function that sees the uncertain rows only."""
    import numpy as np

    def rule(x):
        shock = np.abs(x[:, 6]) + np.abs(x[:, 7])
        rate = np.abs(x[:, 8]) + np.abs(x[:, 4])
        a, b = x[:, 10], x[:, 11]
        logit = 1.8 * a + 2.0 * b + 0.7 * shock + 0.024 * rate + 0.5 * np.abs(a - b) - 4.0
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -15.0, 15.0)))

    gated = C.uncertainty_gate(probabilities(features(spark, sf)))
    out = selective_override(gated, rule).select("seq", "escalated", "p_final")
    return rounded(out, "p_final")


@query("decide", sql(SQL_RECORDS, f"""
select seq, case when anomaly_type = 'FLATLINE' then null else is_anomaly end as is_anomaly,
  case when anomaly_type = 'FLATLINE' then 'UNKNOWN' else prediction end as prediction,
  {s6("case when anomaly_type = 'FLATLINE' then 0e0 else anomaly_score end", 'anomaly_score')}
from rec where system_name = 'selective'"""))
def _(spark, sf):
    rows = records(spark, sf).withColumn("p_final", F.when(
        F.col("anomaly_type") != "FLATLINE", F.col("p_final")))
    return rounded(C.decide(rows).select("seq", "is_anomaly", "prediction", "anomaly_score"),
                   "anomaly_score")


@query("reason_code", sql(SQL_RECORDS, "select seq, system_name, anomaly_reasons from rec"))
def _(spark, sf):
    return two_mode_records(spark, sf).select("seq", "system_name", "anomaly_reasons")


@query("route_labels", sql(SQL_RECORDS, """
select seq, engine, system_name from rec"""))
def _(spark, sf):
    return two_mode_records(spark, sf).select("seq", "engine", "system_name")


@query("processing_latency", sql(SQL_READINGS, """
select seq, case when label = 1 then 0e0 else cast(greatest(0, (seq * 37) % 5000 - 1000) as double)
  end as processing_latency_ms from r"""))
def _(spark, sf):
    rows = readings(spark, sf).withColumns({
        "processed_at_epoch_ms": F.col("sent_at_epoch_ms") + (F.col("seq") * 37) % 5000 - 1000,
        "sent_at_epoch_ms": F.when(F.col("label") == 1, F.lit(0).cast("long"))
        .otherwise(F.col("sent_at_epoch_ms"))})
    return C.processing_latency(rows).select("seq", "processing_latency_ms")


@query("heuristic_score", sql(SQL_SCORED, f"""
select seq, {s6('''1e0 / (1e0 + exp(-greatest(-15e0, least(15e0, 18e-1 * p_if + 2e0 * p_ae
  + 7e-1 * (abs(z_temp_15m) + abs(z_volt_15m)) + 12e-1 * (abs(temp_slope_15m)
  + abs(delta_temp_3m)) + 5e-1 * abs(p_if - p_ae) - 22e-1))))''', 'p_heuristic')} from g"""))
def _(spark, sf):
    out = C.heuristic_score(probabilities(features(spark, sf)))
    return rounded(out.select("seq", "p_heuristic"), "p_heuristic")


@query("alerts", sql(SQL_RECORDS, """
select event_id, system_name from rec where is_anomaly = 1 and anomaly_type <> 'FLATLINE'"""))
def _(spark, sf):
    rows = two_mode_records(spark, sf).withColumn("is_anomaly", F.when(
        F.col("anomaly_type") != "FLATLINE", F.col("is_anomaly")))
    return C.alerts(rows).select("event_id", "system_name")


@query("uncertain_branch", sql(SQL_RECORDS, """
select event_id, system_name from rec where uncertain"""))
def _(spark, sf):
    return C.uncertain_branch(two_mode_records(spark, sf)).select("event_id", "system_name")


@query("decision_payload", sql(SQL_SCORED, f"""
select seq, moteid, epoch, temperature, {s6('z_volt_15m')}, {s6('p_ae')}, 14 as fields
from g where uncertain"""))
def _(spark, sf):
    rows = C.decision_payload(C.uncertain_branch(scored(spark, sf)))
    body = F.from_json("payload", "moteid int, epoch int, temperature double,"
                                  " z_volt_15m double, p_ae double")
    out = rows.select("seq", body.alias("b"),
                      F.size(F.json_object_keys("payload")).alias("fields"))
    return rounded(out.select("seq", "b.*", "fields"), "z_volt_15m", "p_ae")


_SHOWN = ["temperature", "z_temp_15m", "delta_temp_3m", "temp_slope_15m", "voltage", "z_volt_15m",
          "delta_volt_3m", "humidity", "light", "p_if", "p_ae"]


@query("state_report_text", sql(SQL_SCORED, """
select seq, printf('Telemetry Report: Mote %d, Epoch %d. Temperature=%.2fC (z-score=%.2f, '
  || '3m-shock=%+.2fC, 15m-slope=%+.3fC/step). Voltage=%.2fV (z-score=%.2f, 3m-shock=%+.2fV). '
  || 'Humidity=%.1f%%, Light=%.1f Lux. Fast Path Prior: IF anomaly probability=%.3f, '
  || 'AE anomaly probability=%.3f.', moteid, epoch, """ + ", ".join(
    f"{c} + 1.83e-7" for c in _SHOWN) + ") as report from g"))
def _(spark, sf):
    # Shifted off decimal ties, where the two engines round differently.
    rows = scored(spark, sf)
    return C.state_report_text(rows.withColumns({c: F.col(c) + 1.83e-7 for c in _SHOWN})).select(
        "seq", "report")


@query("decision_result", sql(SQL_SCORED + """,
x as (select g.*, e.event_type, e.k from g join e on g.seq = e.event_id where uncertain),
y as (select seq, case when p_fallback >= 5e-1 then 'ANOMALY' else 'NORMAL' end as answer,
    5e-1 + k / 1000e0 as sure, event_type,
    case event_type when 'error' then 'TIMEOUT' when 'signup' then 'HTTP_503:busy try later'
      when 'purchase' then 'INVALID_RESPONSE:unreadable JSON' else 'OK' end as inference_status
  from x)""", f"""
select seq, inference_status,
  {s6("case when inference_status = 'OK' then sure end", 'p_final')},
  case when inference_status <> 'OK' then 'UNKNOWN' when event_type = 'click' then 'UNKNOWN'
    else answer end as prediction,
  case when inference_status <> 'OK' then null
    when event_type <> 'click' and answer = 'ANOMALY' then 1 else 0 end as is_anomaly,
  {s6("case when inference_status = 'OK' then sure else 0e0 end", 'anomaly_score')},
  case when inference_status = 'OK' then 'External comparison'
    else 'External comparison unavailable' end as anomaly_reasons,
  'external' as system_name from y"""))
def _(spark, sf):
    kinds = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("seq"), "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    rows = C.uncertain_branch(scored(spark, sf)).join(kinds, "seq")
    kind = F.col("event_type")
    label = F.when(F.col("p_fallback") >= 0.5, "ANOMALY").otherwise("NORMAL")
    sure = (0.5 + F.col("k") / 1000.0).alias("confidence")
    body = F.to_json(F.struct(F.when(kind != "click", label).alias("decision"), sure))
    answers = rows.withColumns({
        "http_status": F.when(kind == "signup", 503).when(kind != "error", 200),
        "response": F.when(kind == "signup", "  busy\n\n try   later ")
        .when(kind == "purchase", "{not json").when(kind != "error", body),
        "error": F.lit(None).cast("string")})
    return rounded(C.decision_result(answers).select(
        "seq", "inference_status", "p_final", "prediction", "is_anomaly", "anomaly_score",
        "anomaly_reasons", "system_name"), "p_final", "anomaly_score")


SQL_SHOWN = SQL_RECORDS + """,
shown as (select *, case when moteid < 10 then '0' || cast(moteid as varchar)
    else cast(moteid as varchar) end as mote,
  case when is_anomaly = 1 then 'high' when escalated then 'review' else 'normal' end as priority,
  case when anomaly_reasons in ('', 'NORMAL') then prediction
    else replace(anomaly_reasons, '_', ' ') end as display_type,
  case when is_anomaly = 1 then 'Anomaly' when escalated then 'Escalated' else 'Normal' end
    as state from rec)"""


@query("event_priority", sql(SQL_SHOWN, """
select event_id, system_name, mote, priority, display_type, state from shown"""))
def _(spark, sf):
    return C.event_priority(two_mode_events(spark, sf)).select(
        "event_id", "system_name", "mote", "priority", "display_type", "state")


@query("event_search", sql(SQL_SHOWN, """
select event_id, system_name, mote from shown where contains(mote, '07')
  or contains(lower(display_type), '07') or contains(lower(event_id), '07')"""))
def _(spark, sf):
    shown = C.event_priority(two_mode_events(spark, sf))
    return C.event_search(shown, " Mote #07").select("event_id", "system_name", "mote")


@query("filter_events", sql(SQL_RECORDS, """
select event_id, 'high' as chosen from rec where system_name = 'selective' and is_anomaly = 1
union all select event_id, 'review' from rec where system_name = 'selective' and escalated
union all select event_id, 'mote' from rec where system_name = 'fast' and moteid = 7"""))
def _(spark, sf):
    events = two_mode_events(spark, sf)
    parts = [C.filter_events(events, "run-a", "selective", priority="high"),
             C.filter_events(events, "run-a", "selective", priority="review"),
             C.filter_events(events, "run-a", "fast", mote=7)]
    named = [p.select("event_id", F.lit(n).alias("chosen"))
             for p, n in zip(parts, ("high", "review", "mote"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("valid_run_id", """
select url, coalesce(regexp_full_match(url, '[A-Za-z0-9_-]{1,80}'), false) as whole,
  coalesce(regexp_full_match(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'),
    '[A-Za-z0-9_-]{1,80}'), false) as stripped from pages""")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        "url", C.valid_run_id("url").alias("whole"),
        C.valid_run_id(F.regexp_replace("url", "[^A-Za-z0-9_-]", "")).alias("stripped"))


@query("probability_check", sql(SQL_SCORED, """
select seq from g where not (p_if + 1e-1 between 0 and 1) or label = 1"""))
def _(spark, sf):
    rows = scored(spark, sf).withColumns({
        "p_if": F.col("p_if") + 0.1, "p_ae": F.when(F.col("label") == 0, F.col("p_ae"))})
    return C.probability_check(rows).select("seq")


@query("pct_format", sql(SQL_SCORED + """,
t as (select moteid, count(*) as n, sum(case when uncertain then 1 else 0 end) as u
  from g group by moteid)""", f"""
select moteid, printf('%.1f%%', round((u * 1e2 / n), 1)) as share,
  {s6('round(u * 1e2 / n, 1)', 'back')}, {s6('u * 1e2 / n', 'plain')} from t"""))
def _(spark, sf):
    share = scored(spark, sf).groupBy("moteid").agg(
        F.count_if("uncertain").alias("u"), F.count("*").alias("n"))
    value = F.col("u") / F.col("n")
    out = share.withColumn("share", C.pct_format(value))
    return out.select("moteid", "share", r6(C.pct_parse("share")).alias("back"),
                      r6(C.pct_parse(value.cast("string"))).alias("plain"))


@query("column_append")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from sieveguard.detectors.fallback import column_append
    return column_append(scored(spark, sf)).select(
        "seq", vector_to_array("inputs").alias("inputs"))
