"""Offline studies: systems compared on labels, and the escalation sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.functions.columns import ensemble_mean, pct_format
from sieveguard.operators.aggregates import detection_metrics, family_column, ratio
from sieveguard.operators.ordering import running_totals
from sieveguard.operators.ranking import ranking_metrics
from sieveguard.operators.topk import SWEEP_RATES, escalation_bands
from sieveguard.scratch import written


def system_scores(df: DataFrame, fallback: Column | str | None = None,
                  heuristic: Column | str | None = None,
                  external: Column | str | None = None) -> dict[str, Column]:
    """Probability of each system: the detectors A and B, their mean C, and the mean with
    uncertain rows overridden by a stronger score (D, E, F, where given)."""
    mean = ensemble_mean()
    out = {"A": F.col("p_if"), "B": F.col("p_ae"), "C": mean}
    for name, score in (("D", fallback), ("E", heuristic), ("F", external)):
        if score is not None:
            score = F.col(score) if isinstance(score, str) else score
            out[name] = F.when(F.col("uncertain"), score).otherwise(mean)
    return out


def union_systems(df: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """Long rows (system, p, label, anomaly_type, uncertain) from one pass."""
    packed = F.array(*[F.struct(F.lit(n).alias("system"), p.alias("p"))
                       for n, p in systems.items()])
    return df.select("label", "anomaly_type", "uncertain", F.explode(packed).alias("s")).select(
        F.col("s.system").alias("system"), F.col("s.p").alias("p"), "label", "anomaly_type",
        "uncertain")


def evaluate_systems(df: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """Quality of each system: precision, recall, F1, both areas, false-positive rate,
    recall per anomaly family and share escalated.

    ``df`` needs p_if, p_ae, uncertain, label and anomaly_type.  Scores are written once;
    threshold counts and ranking areas read that table.
    """
    long = written(union_systems(df, systems), "systems")
    truth, hit = F.col("label") == 1, F.col("p") >= S.THRESHOLD
    family = family_column()
    counts = long.groupBy("system").agg(
        F.count("*").alias("n"), F.count_if(truth & hit).alias("tp"),
        F.count_if(~truth & hit).alias("fp"), F.count_if(truth & ~hit).alias("fn"),
        F.count_if(~truth & ~hit).alias("tn"), F.count_if("uncertain").alias("_up"),
        *[F.count_if(truth & (family == f)).alias(f"_n_{f}") for f in S.FAMILIES],
        *[F.count_if(truth & hit & (family == f)).alias(f"_c_{f}") for f in S.FAMILIES])
    quality = detection_metrics(counts, zero_division=0.0)
    areas = ranking_metrics(long, ["system"], score="p")
    up = F.when(F.col("system").isin("A", "B", "C"), 0.0).otherwise(
        F.col("_up") * 100.0 / F.col("n"))
    return quality.join(areas, "system").select(
        "system", "precision", "recall", "f1", "pr_auc", "roc_auc", "fpr",
        *[ratio(F.col(f"_c_{f}").cast("double"), F.col(f"_n_{f}"), 0.0).alias(f"{f}_recall")
          for f in S.FAMILIES],
        up.alias("escalation_pct"))


def result_table(evaluated: DataFrame) -> DataFrame:
    """The evaluation as shown to people: shares as text with one decimal."""
    shares = {f"{f}_recall": pct_format(f"{f}_recall") for f in S.FAMILIES}
    return evaluated.withColumns({**shares, "escalation_pct": F.format_string(
        "%.1f%%", "escalation_pct")})


def sweep_rates_join(df: DataFrame, rates: Sequence[float] = SWEEP_RATES,
                     fallback: str = "p_fallback", unique: str = "event_id") -> DataFrame:
    """Confusion counts at every rate from one aggregation, without multiplying rows."""
    banded, counts = escalation_bands(df, rates, unique)
    return _rate_counts(banded, rates, counts, fallback)


def _rate_counts(banded: DataFrame, rates: Sequence[float], counts: Sequence[int],
                 fallback: str) -> DataFrame:
    fast, strong, truth = ensemble_mean(), F.col(fallback), F.col("label") == 1
    cells = []
    for i in range(len(rates)):
        hit = F.when(F.col("band") <= i, strong).otherwise(fast) >= S.THRESHOLD
        for name, test in (("tp", truth & hit), ("fp", ~truth & hit), ("fn", truth & ~hit),
                           ("tn", ~truth & ~hit)):
            cells.append(F.count_if(test).alias(f"{name}{i}"))
    wide = banded.agg(*cells)
    parts = ", ".join(f"double({r!r}), bigint({c}), tp{i}, fp{i}, fn{i}, tn{i}"
                      for i, (r, c) in enumerate(zip(rates, counts)))
    return wide.select(F.expr(
        f"stack({len(rates)}, {parts}) as (rate, escalated, tp, fp, fn, tn)"))


def _rate_areas(banded: DataFrame, rates: Sequence[float], fallback: str) -> DataFrame:
    """Average precision at every rate from one ordered pass.

    A row gives two records: its fast score, which counts below its band, and its strong
    score, which counts from its band on.  Records collapse by score with one counter per
    rate, so all rates share one sort.
    """
    pair = F.array(F.struct(ensemble_mean().alias("p"), F.lit(False).alias("strong")),
                   F.struct(F.col(fallback).alias("p"), F.lit(True).alias("strong")))
    records = banded.select("label", "band", F.explode(pair).alias("r"))
    truth = F.col("label") == 1
    def on(i: int) -> Column:
        return F.when(F.col("r.strong"), F.col("band") <= i).otherwise(F.col("band") > i)
    k = len(rates)
    grouped = records.groupBy(F.col("r.p").alias("_score")).agg(
        *[F.count_if(truth & on(i)).alias(f"_p{i}") for i in range(k)],
        *[F.count_if(~truth & on(i)).alias(f"_q{i}") for i in range(k)])
    sums = {f"_{a}{i}": f"_{b}{i}" for i in range(k) for a, b in (("p", "tp"), ("q", "fp"))}
    run = running_totals(grouped, ["-_score"], sums)
    wide = run.agg(*[ratio(
        F.sum(F.when(F.col(f"_p{i}") > 0, F.col(f"_p{i}") * F.col(f"_tp{i}")
                     / (F.col(f"_tp{i}") + F.col(f"_fp{i}")))),
        F.max(f"_tp{i}_total")).alias(f"ap{i}") for i in range(k)])
    parts = ", ".join(f"double({r!r}), ap{i}" for i, r in enumerate(rates))
    return wide.select(F.expr(f"stack({k}, {parts}) as (rate, pr_auc)"))


def escalation_sweep(df: DataFrame, rates: Sequence[float] = SWEEP_RATES,
                     fallback: str = "p_fallback", unique: str = "event_id") -> DataFrame:
    """F1, precision, recall, average precision and false-positive rate when the top
    share of rows by uncertainty takes the stronger score.

    The scores are written once; the rank search, the counts and the ordered pass read
    that narrow table.
    """
    base = written(df.select(unique, "p_if", "p_ae", fallback, "label"), "sweep")
    banded, counts = escalation_bands(base, rates, unique, stored=True)
    quality = detection_metrics(_rate_counts(banded, rates, counts, fallback), 0.0)
    return quality.join(_rate_areas(banded, rates, fallback), "rate").select(
        "rate", "escalated", "f1", "precision", "recall", "pr_auc", "fpr")


# Fixed value: assumed transport limit in events per second.
TRANSPORT_CAPACITY = 35_000.0


def capacity_estimate(df: DataFrame, cap: float = TRANSPORT_CAPACITY) -> DataFrame:
    """Estimated (not measured) events per second from rate, fast_us and fallback_us."""
    service = F.col("fast_us") + F.col("rate") * F.col("fallback_us")
    timed = df.withColumn("service_us", service)
    return timed.withColumns({
        "transport_capacity": F.lit(float(cap)),
        "estimated_capacity": F.when(F.col("service_us") > 0, F.least(
            F.lit(float(cap)), 1e6 / F.nullif(F.col("service_us"), F.lit(0.0)))).otherwise(0.0)})


def parity_check(a: DataFrame, b: DataFrame, key: str = "event_id", tol: float = 1e-5,
                 scores: Sequence[str] = ("p_if", "p_ae", "p_final"),
                 flags: Sequence[str] = ("escalated",)) -> DataFrame:
    """Rows on which two score tables differ: missing, over the tolerance, other flag."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in (*scores, *flags)],
                    F.lit(True).alias("_a"))
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in (*scores, *flags)],
                     F.lit(True).alias("_b"))
    both = left.join(right, key, "full_outer")
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    off = F.lit(False)
    for c in scores:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
    flag = F.lit(False)
    for c in flags:
        flag = flag | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    problem = F.when(missing, "missing").when(off, "score").when(flag, "flag")
    return both.withColumn("problem", problem).where("problem is not null").drop("_a", "_b")
