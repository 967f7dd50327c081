"""Column expressions of scoring, gating and deciding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column, clip: float = S.CLIP) -> Column:
    """Logistic function of x within ±clip; null for null and NaN."""
    bounded = F.greatest(F.lit(-clip), F.least(F.lit(clip), x))
    return F.when(x.isNotNull() & ~F.isnan(x), F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded)))


def calibrated_prob(score: Column | str, coef: float, intercept: float,
                    clip: float = S.CLIP) -> Column:
    """Probability of an anomaly from a raw score and a fitted slope and offset."""
    return sigmoid(F.lit(float(coef)) * _col(score) + F.lit(float(intercept)), clip)


def ensemble_mean(p1: Column | str = "p_if", p2: Column | str = "p_ae") -> Column:
    return F.lit(0.5) * (_col(p1) + _col(p2))


def in_margin(p: Column, low: float, high: float) -> Column:
    return (p > low) & (p < high)


def disagreement(p1: Column | str = "p_if", p2: Column | str = "p_ae") -> Column:
    return (_col(p1) >= S.THRESHOLD) != (_col(p2) >= S.THRESHOLD)


def uncertainty_gate(df: DataFrame, low: float = S.MARGIN_LOW, high: float = S.MARGIN_HIGH,
                     p1: str = "p_if", p2: str = "p_ae") -> DataFrame:
    """Adds ``disagreement`` and ``uncertain``; the margin bounds are open."""
    split = disagreement(p1, p2)
    close = in_margin(F.col(p1), low, high) | in_margin(F.col(p2), low, high)
    return df.withColumns({"disagreement": split, "uncertain": close | split})


def uncertainty_score(p1: Column | str = "p_if", p2: Column | str = "p_ae") -> Column:
    a, b = _col(p1), _col(p2)
    def nearness(p: Column) -> Column:
        return 1.0 - 2.0 * F.abs(p - 0.5)
    return 1.5 * F.abs(a - b) + nearness(a) + nearness(b)


# Weights and offset of the rule-based score.
HEURISTIC_WEIGHTS = {
    "p_if": 1.8, "p_ae": 2.0, "shock": 0.7, "rate": 1.2, "disagree": 0.5, "offset": -2.2,
}
HEURISTIC_CLIP = 15.0


def heuristic_prob(weights: dict[str, float] | None = None) -> Column:
    """Rule-based probability from both priors, the z-scores and the rates of change.

    Missing features count as 0, as in the detectors; a missing prior gives null.
    """
    w = {**HEURISTIC_WEIGHTS, **(weights or {})}
    a, b = F.col("p_if"), F.col("p_ae")
    shock = F.abs(clean("z_temp_15m")) + F.abs(clean("z_volt_15m"))
    rate = F.abs(clean("temp_slope_15m")) + F.abs(clean("delta_temp_3m"))
    logit = (w["p_if"] * a + w["p_ae"] * b + w["shock"] * shock + w["rate"] * rate
             + w["disagree"] * F.abs(a - b) + w["offset"])
    return sigmoid(logit, HEURISTIC_CLIP)


def heuristic_score(df: DataFrame, name: str = "p_heuristic",
                    weights: dict[str, float] | None = None) -> DataFrame:
    return df.withColumn(name, heuristic_prob(weights))


def clean(c: Column | str, as_float: bool = False) -> Column:
    """Null, NaN and infinities become 0."""
    x = _col(c).cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = F.when(good, x).otherwise(F.lit(0.0))
    return out.cast("float") if as_float else out


def clean_features(df: DataFrame, as_float: bool = False) -> DataFrame:
    return df.withColumns({c: clean(c, as_float) for c in S.FEATURES})


def standardize(df: DataFrame, means: Sequence[float], stds: Sequence[float],
                prefix: str = "std_") -> DataFrame:
    """Adds ``(x - mean) / std`` for each feature."""
    return df.withColumns({
        f"{prefix}{c}": (F.col(c) - F.lit(float(m))) / F.lit(float(s))
        for c, m, s in zip(S.FEATURES, means, stds, strict=True)})


def default_identity(df: DataFrame, now_ms: int | Column) -> DataFrame:
    """Fill in missing run, event and send time."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    named = df.withColumn("run_id", F.when(blank("run_id"), "manual").otherwise(F.col("run_id")))
    return named.withColumns({
        "event_id": F.when(blank("event_id"), F.concat_ws(
            ":", "run_id", F.col("moteid").cast("string"), F.col("epoch").cast("string")))
        .otherwise(F.col("event_id")),
        "sent_at_epoch_ms": F.when(F.coalesce("sent_at_epoch_ms", F.lit(0)) <= 0,
                                   now.cast("long")).otherwise(F.col("sent_at_epoch_ms")),
    })


def decide(df: DataFrame, threshold: float = S.THRESHOLD, p: str = "p_final") -> DataFrame:
    """Class, label and score; an unknown probability gives an unknown decision."""
    known, hit = F.col(p).isNotNull(), F.col(p) >= threshold
    return df.withColumns({
        "is_anomaly": F.when(known, hit.cast("int")),
        "prediction": F.when(~known, "UNKNOWN").when(hit, "ANOMALY").otherwise("NORMAL"),
        "anomaly_score": F.coalesce(F.col(p), F.lit(0.0)),
    })


def reason_code(df: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    high, up = F.col("p_final") >= threshold, F.col("escalated")
    return df.withColumn(
        "anomaly_reasons",
        F.when(~high & up, "FALLBACK_NORMAL").when(~high, "NORMAL")
        .when(up & F.col("disagreement"), "FALLBACK_AFTER_DISAGREEMENT")
        .when(up, "FALLBACK_AFTER_MARGIN_UNCERTAINTY")
        .otherwise("FAST_PATH_ANOMALY"))


def route_labels(df: DataFrame, mode: str) -> DataFrame:
    return df.withColumns({
        "engine": F.when(F.col("escalated"), S.ENGINE_FALLBACK).otherwise(S.ENGINE_FAST),
        "system_name": F.lit(mode),
        "inference_status": F.lit("OK"),
    })


def processing_latency(df: DataFrame) -> DataFrame:
    sent, done = F.col("sent_at_epoch_ms"), F.col("processed_at_epoch_ms")
    return df.withColumn(
        "processing_latency_ms",
        F.when(sent > 0, F.greatest(F.lit(0.0), (done - sent).cast("double"))).otherwise(0.0))


def alerts(df: DataFrame) -> DataFrame:
    """Rows decided as anomalies; an unknown decision is no alert."""
    return df.where(F.col("is_anomaly") == 1)


def uncertain_branch(df: DataFrame) -> DataFrame:
    return df.where("uncertain")


def decision_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """JSON request for an external decision model."""
    return df.withColumn(name, F.to_json(F.struct(*S.REQUEST_FIELDS)))


def state_report_text(df: DataFrame, name: str = "report") -> DataFrame:
    """The row as a sentence with fixed decimals (ties round half up)."""
    return df.withColumn(name, F.format_string(
        "Telemetry Report: Mote %d, Epoch %d. "
        "Temperature=%.2fC (z-score=%.2f, 3m-shock=%+.2fC, 15m-slope=%+.3fC/step). "
        "Voltage=%.2fV (z-score=%.2f, 3m-shock=%+.2fV). "
        "Humidity=%.1f%%, Light=%.1f Lux. "
        "Fast Path Prior: IF anomaly probability=%.3f, AE anomaly probability=%.3f.",
        "moteid", "epoch", "temperature", "z_temp_15m", "delta_temp_3m", "temp_slope_15m",
        "voltage", "z_volt_15m", "delta_volt_3m", "humidity", "light", "p_if", "p_ae"))


DETAIL_CHARS = 220


def decision_result(df: DataFrame, response: str = "response", http: str = "http_status",
                    error: str = "error") -> DataFrame:
    """Decision columns from an external answer.

    The answer's own label decides, not the threshold.  ``error`` carries the status of
    a call that never got an answer (``TIMEOUT``, ``FAILED:...``, ``REQUEST_ERROR:...``).
    """
    body = F.from_json(F.col(response), "decision string, confidence double, bad string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    read = df.withColumn("_body", body)
    http_ok = (F.col(http) >= 200) & (F.col(http) < 300)
    line = F.substring(F.trim(F.regexp_replace(
        F.coalesce(F.col(response), F.lit("")), r"\s+", " ")), 1, DETAIL_CHARS)
    http_text = F.concat(F.lit("HTTP_"), F.col(http).cast("string"),
                         F.when(line == "", "").otherwise(F.concat(F.lit(":"), line)))
    broken = F.col("_body").isNull() | F.col("_body.bad").isNotNull()
    status = (F.when(F.col(error).isNotNull(), F.col(error))
              .when(F.col(http).isNull(), F.lit("TIMEOUT"))
              .when(~http_ok, http_text)
              .when(broken, F.lit("INVALID_RESPONSE:unreadable JSON"))
              .otherwise("OK"))
    read = read.withColumn("inference_status", status)
    ok = F.col("inference_status") == "OK"
    label = F.coalesce("_body.decision", F.lit("UNKNOWN"))
    sure = F.coalesce("_body.confidence", F.lit(0.0))
    return read.withColumns({
        "p_final": F.when(ok, sure),
        "prediction": F.when(ok, label).otherwise("UNKNOWN"),
        "is_anomaly": F.when(ok, (F.upper(label) == "ANOMALY").cast("int")),
        "anomaly_score": F.when(ok, sure).otherwise(0.0),
        "anomaly_reasons": F.when(ok, "External comparison").otherwise(
            "External comparison unavailable"),
        "uncertain": F.lit(True),
        "escalated": F.lit(True),
        "system_name": F.lit(S.MODE_EXTERNAL),
        "engine": F.lit(S.ENGINE_EXTERNAL),
    }).drop("_body")


def event_priority(df: DataFrame) -> DataFrame:
    """Display columns: padded mote, priority, type text and state."""
    high = F.coalesce(F.col("is_anomaly") == 1, F.lit(False))
    up = F.coalesce(F.col("escalated").cast("int") == 1, F.lit(False))
    reason = F.col("anomaly_reasons")
    plain = F.coalesce(reason, F.lit("")).isin("", "NORMAL")
    kind = F.when(plain, F.col("prediction")).otherwise(F.translate(reason, "_", " "))
    padded = F.col("moteid").cast("string")
    padded = F.when(F.length(padded) < 2, F.lpad(padded, 2, "0")).otherwise(padded)
    return df.withColumns({
        "mote": F.coalesce(padded, F.lit("0?")),
        "priority": F.when(high, "high").when(up, "review").otherwise("normal"),
        "display_type": F.when(F.coalesce(kind, F.lit("")) == "", "Event").otherwise(kind),
        "state": F.when(F.coalesce(F.col("inference_status"), F.lit("")) != "OK", "Unavailable")
        .when(high, "Anomaly").when(up, "Escalated").otherwise("Normal"),
    })


def event_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search over an :func:`event_priority` frame."""
    query = text.strip().lower()
    if query.startswith("mote"):
        query = query[4:].lstrip()
        query = query[1:] if query.startswith("#") else query
    if not query:
        return df
    return df.where(F.contains(F.col("mote"), F.lit(query))
                    | F.contains(F.lower("display_type"), F.lit(query))
                    | F.contains(F.lower("event_id"), F.lit(query)))


def filter_events(df: DataFrame, run_id: str, system: str, mote: int | None = None,
                  priority: str = "all") -> DataFrame:
    """Rows of one run and system; here ``review`` means every escalated row."""
    if system not in S.MODES:
        raise ValueError(f"system must be one of {S.MODES}")
    if priority not in ("all", "high", "review"):
        raise ValueError("priority must be all, high or review")
    out = df.where((F.col("run_id") == run_id) & (F.col("system_name") == system))
    if mote is not None:
        out = out.where(F.col("moteid") == mote)
    if priority == "high":
        out = out.where(F.col("is_anomaly") == 1)
    elif priority == "review":
        out = out.where(F.col("escalated").cast("int") == 1)
    return out


def valid_run_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^[\p{L}\p{N}_-]{1,80}\z"), F.lit(False))


def probability_check(df: DataFrame, names: Sequence[str] = ("p_if", "p_ae")) -> DataFrame:
    """Rows whose probabilities are missing or outside [0, 1]."""
    bad = F.lit(False)
    for n in names:
        bad = bad | ~F.coalesce(F.col(n).between(0.0, 1.0), F.lit(False))
    return df.where(bad)


def pct_format(c: Column | str) -> Column:
    return F.format_string("%.1f%%", _col(c) * 100.0)


def pct_parse(c: Column | str) -> Column:
    """``'12.3%'`` to 12.3; a bare fraction is multiplied by 100."""
    text = F.trim(_col(c).cast("string"))
    number = F.regexp_replace(text, "%", "").try_cast("double")
    return F.when(F.contains(text, F.lit("%")), number).otherwise(number * 100.0)
