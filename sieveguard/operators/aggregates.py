"""Summaries of decisions: counts, rates, quality and time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard import schema as S
from sieveguard.operators.ordering import running_totals

BY_RUN = ("run_id", "system_name")


def _truth(df: DataFrame) -> Column:
    return F.col("ground_truth" if "ground_truth" in df.columns else "label")


def _counts(truth: Column, guess: Column) -> dict[str, Column]:
    """Cells of the confusion matrix; rows with an unknown side count nowhere."""
    return {
        "tp": F.count_if((truth == 1) & (guess == 1)),
        "fp": F.count_if((truth == 0) & (guess == 1)),
        "fn": F.count_if((truth == 1) & (guess == 0)),
        "tn": F.count_if((truth == 0) & (guess == 0)),
    }


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), guess: str = "is_anomaly") -> DataFrame:
    return df.groupBy(*by).agg(
        *[c.alias(n) for n, c in _counts(_truth(df), F.col(guess)).items()])


def run_summary(df: DataFrame, by: Sequence[str] = BY_RUN) -> DataFrame:
    """Counts and first / last processing time per run and system."""
    flag = {n: F.count_if(F.col(n).cast("int") == 1) for n in ("uncertain", "escalated")}
    cells = _counts(_truth(df), F.col("is_anomaly"))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
        *[c.alias(n) for n, c in {**flag, **cells}.items()],
        F.min("processed_at_epoch_ms").alias("first_ms"),
        F.max("processed_at_epoch_ms").alias("last_ms"))


def ratio(top: Column, bottom: Column, zero_division: float | None = None) -> Column:
    out = top / F.nullif(bottom, F.lit(0))
    return out if zero_division is None else F.coalesce(out, F.lit(float(zero_division)))


def detection_metrics(df: DataFrame, zero_division: float | None = None) -> DataFrame:
    """Precision, recall, F1 and false-positive rate from tp, fp, fn, tn.

    An empty denominator gives null, or ``zero_division``.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumns({
        "precision": ratio(tp, tp + fp, zero_division),
        "recall": ratio(tp, tp + fn, zero_division),
        "fpr": ratio(fp, fp + tn, zero_division),
    })
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2.0 * p * r, p + r, zero_division))


def throughput(df: DataFrame) -> DataFrame:
    span = (F.col("last_ms") - F.col("first_ms")) / 1000.0
    live = (F.col("total") > 1) & (F.col("last_ms") > F.col("first_ms"))
    return df.withColumn("throughput_eps", F.when(
        live, F.round(F.col("total") / F.nullif(span, F.lit(0.0)), 2)).otherwise(0.0))


def escalation_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("escalation_rate", ratio(
        F.col("escalated").cast("double"), F.col("total"), 0.0))


def latency_quantiles(df: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99),
                      by: Sequence[str] = BY_RUN, exact: bool = False,
                      col: str = "processing_latency_ms") -> DataFrame:
    """p50, p95, ... per group: a mergeable sketch, or exact with interpolation."""
    names = [f"p{round(q * 100):d}_ms" for q in probs]
    if exact:
        return exact_quantiles(df, col, dict(zip(names, probs)), by)
    packed = df.groupBy(*by).agg(F.percentile_approx(col, list(probs), 10_000).alias("_q"))
    return packed.select(*by, *[F.coalesce(F.col("_q")[i], F.lit(0.0)).alias(n)
                                for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles without holding a group's values in one task.

    Equal values collapse first; running counts over the ordered values then tell which
    value sits at each rank.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).count()
    run = running_totals(counts, [col], {"count": "_cum"}, by)
    picks = []
    for name, q in probs.items():
        place = (F.col("_cum_total") - 1) * F.lit(float(q))
        low = F.floor(place)
        picks += [
            F.min(F.when(F.col("_cum") > low, F.col(col))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(place), F.col(col))).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_part_{name}"),
        ]
    return run.groupBy(*by).agg(*picks).select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
         * F.col(f"_part_{n}")).alias(n) for n in probs])


def run_status(summary: DataFrame, runs: DataFrame,
               systems: Sequence[str] = (S.MODE_FAST, S.MODE_SELECTIVE)) -> DataFrame:
    """State and expected count of each run and system from the run records.

    ``summary`` comes from :func:`run_summary`.  A registered run has a row for each of
    ``systems``, with zero counts where it has no rows yet, and for every system with rows.
    The external system expects one row per uncertain row of the other systems of its run.
    """
    pairs = runs.select("run_id", F.explode(F.array(*map(F.lit, systems)).cast(
        "array<string>")).alias("system_name"))
    summary = summary.join(pairs, ["run_id", "system_name"], "full").select(*[
        F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.LongType) else F.col(f.name) for f in summary.schema.fields])
    external = F.col("system_name") == S.MODE_EXTERNAL
    own = summary.groupBy("run_id").agg(
        F.sum(F.when(~external, F.col("uncertain")).otherwise(0)).alias("_uncertain"))
    meta = runs.select("run_id", "status", "expected_count", "external_enabled")
    both = summary.join(own, "run_id").join(
        meta.withColumnRenamed("status", "_producer"), "run_id", "left")
    done = F.coalesce(F.col("_producer") == "producer_finished", F.lit(False))
    planned = F.coalesce("expected_count", F.lit(0))
    expected = F.when(external, F.col("_uncertain")).otherwise(planned)
    enough = F.col("total") >= expected
    off = external & ~F.coalesce("external_enabled", F.lit(False))
    return both.select(
        *summary.columns, expected.cast("long").alias("expected"),
        F.when(off, "disabled")
        .when(done & (enough | (~external & (planned == 0))), "complete")
        .otherwise("running").alias("status"))


def with_idle(status: DataFrame, run_id: str | None, system: str) -> DataFrame:
    """The status row of the active run; an ``idle`` row when no run is active."""
    one = status.where((F.col("run_id") == F.lit(run_id)) & (F.col("system_name") == system))
    if run_id is not None:
        return one
    row = {"system_name": system, "status": "idle", **{
        f.name: 0 for f in status.schema
        if isinstance(f.dataType, T.LongType)}}
    row |= {c: 0.0 for c in ("escalation_rate", "throughput_eps") if c in status.columns}
    open_schema = T.StructType([T.StructField(f.name, f.dataType) for f in status.schema])
    return status.sparkSession.createDataFrame([row], open_schema)


# Span and bucket length in seconds of each series window.
SERIES_WINDOWS = {"1h": (3600, 60), "6h": (21600, 300), "24h": (86400, 1800)}


def series_bound(df: DataFrame, run_id: str) -> DataFrame:
    """The last processing time of a run, over all systems."""
    return df.where(F.col("run_id") == run_id).agg(
        F.max("processed_at_epoch_ms").alias("last_ms"))


def event_series(df: DataFrame, run_id: str, system: str, window: str = "24h",
                 raw: DataFrame | None = None) -> DataFrame:
    """Counts per time bucket over the latest span of a run.

    ``raw`` is the table before duplicates were removed; its latest row ends the span.
    """
    span, bucket = SERIES_WINDOWS[window]
    last = series_bound(df if raw is None else raw, run_id).scalar()
    recent = df.where((F.col("run_id") == run_id) & (F.col("system_name") == system)
                      & (F.col("processed_at_epoch_ms") >= last - F.lit(span * 1000)))
    slot = F.floor(F.col("processed_at_epoch_ms") / F.lit(1000 * bucket)) * (1000 * bucket)
    return recent.groupBy(slot.cast("long").alias("bucket_ms")).agg(
        F.count("*").alias("readings"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalies"),
        F.count_if(F.col("escalated").cast("int") == 1).alias("escalated"))


def family_column(kind: Column | str = "anomaly_type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(None).cast("string")
    for name, members in S.FAMILIES.items():
        out = F.when(kind.isin(*members), name).otherwise(out)
    return out


def recall_by_family(df: DataFrame, by: Sequence[str] = (), families: bool = True,
                     guess: str = "is_anomaly") -> DataFrame:
    """Share of anomalies found per family, or per anomaly type."""
    name = "family" if families else "anomaly_type"
    group = family_column() if families else F.col("anomaly_type")
    rows = df.withColumn(name, group)
    rows = rows.where(F.col("family").isNotNull() if families
                      else family_column().isNotNull())
    return rows.groupBy(*by, name).agg(
        F.count_if(_truth(df) == 1).alias("total"),
        F.count_if((_truth(df) == 1) & (F.col(guess) == 1)).alias("caught"),
    ).withColumn("recall", ratio(F.col("caught").cast("double"), F.col("total"), 0.0))


def type_breakdown(df: DataFrame, col: str = "anomaly_type") -> DataFrame:
    """Rows and percentage per type, from one pass (few types, so the total is summed
    over the grouped rows)."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def prevalence(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("label").alias("positives"),
                               F.avg("label").alias("prevalence"))


def gate_statistics(df: DataFrame) -> DataFrame:
    up = F.col("uncertain")
    return df.agg(
        F.count_if(up).alias("escalated"), F.count_if(~up).alias("confident"),
        ratio(F.count_if(up) * 100.0, F.count("*")).alias("escalated_pct"),
        ratio(F.count_if(~up) * 100.0, F.count("*")).alias("confident_pct"),
        F.count_if(up & (F.col("label") == 1)).alias("anomalies_in_uncertain"),
        F.count_if(F.col("label") == 1).alias("anomalies"))


def classification_report(df: DataFrame, guess: str = "is_anomaly") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    m = confusion_matrix(df, guess=guess).select(
        *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")])
    rows = m.select(F.expr(
        "stack(2, 'NORMAL', tn, fn, fp, tn + fp, 'ANOMALY', tp, fp, fn, tp + fn)"
        " as (class, hit, wrong, missed, support)"))
    rows = rows.withColumns({"precision": ratio(F.col("hit"), F.col("hit") + F.col("wrong"), 0.0),
                             "recall": ratio(F.col("hit"), F.col("hit") + F.col("missed"), 0.0)})
    p, r = F.col("precision"), F.col("recall")
    rows = rows.withColumn("f1", ratio(2.0 * p * r, p + r, 0.0))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    extra = rows.agg(
        total.alias("n"), ratio(F.sum("hit"), total, 0.0).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[ratio(F.sum(F.col(c) * F.col("support")), total, 0.0).alias(f"w_{c}") for c in names])
    summary = extra.select(F.expr(
        "stack(3, 'accuracy', acc, acc, acc, n, 'macro avg', m_precision, m_recall, m_f1, n,"
        " 'weighted avg', w_precision, w_recall, w_f1, n)"
        " as (class, precision, recall, f1, support)"))
    return rows.select("class", *names, "support").unionByName(summary).withColumn(
        "support", F.col("support").cast("long"))


def scaler_stats(df: DataFrame, cols: Sequence[str] = tuple(S.FEATURES),
                 eps: float = S.STD_EPSILON) -> DataFrame:
    """Mean and population deviation (plus eps) of each column, one row per column."""
    flat = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                  *[(F.stddev_pop(c) + eps).alias(f"s_{c}") for c in cols])
    parts = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    return flat.select(F.expr(f"stack({len(cols)}, {parts}) as (feature, mean, std)"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight of each class and the weight ratio for boosted trees."""
    n, pos = F.count("label"), F.count_if(F.col("label") == 1)
    counts = df.agg(n.alias("n"), pos.alias("pos")).withColumn("neg", F.col("n") - F.col("pos"))
    return counts.select(
        "n", "pos", "neg",
        ratio(F.col("n").cast("double"), 2.0 * F.col("neg")).alias("weight_normal"),
        ratio(F.col("n").cast("double"), 2.0 * F.col("pos")).alias("weight_anomaly"),
        F.greatest(F.lit(1.0), F.col("neg") / (F.col("pos") + 1e-4)).alias("scale_pos_weight"))


def error_profile(df: DataFrame, col: str = "reconstruction_error",
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean and exact 95th percentile of an error column."""
    mean = df.groupBy(*by).agg(F.avg(col).alias("mean_error"))
    p95 = exact_quantiles(df, col, {"p95_error": 0.95}, by)
    if by:
        return mean.join(p95, list(by))
    return mean.withColumn("p95_error", p95.scalar())


def mode_comparison(df: DataFrame, exact: bool = False) -> DataFrame:
    """One quality and speed row per run and mode."""
    full = escalation_rate(throughput(detection_metrics(run_summary(df))))
    joined = full.join(latency_quantiles(df, exact=exact), list(BY_RUN))
    return joined.select(
        "run_id", F.col("system_name").alias("mode"), F.col("total").alias("events"), "f1",
        "precision", "recall", "fpr", "escalation_rate",
        F.col("throughput_eps").alias("throughput_events_per_second"),
        *[F.col(f"p{q}_ms").alias(f"latency_p{q}_ms") for q in (50, 95, 99)])
