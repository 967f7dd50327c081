"""Exact ranking metrics and cumulative reports, built on running totals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveguard.operators.aggregates import detection_metrics, ratio
from sieveguard.operators.ordering import ordered_sequence, running_totals
from sieveguard.scratch import written


def _by_score(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives at each distinct score, with running counts from the top."""
    grouped = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    return running_totals(grouped, ["-_score"], {"_pos": "_tp", "_neg": "_fp"}, by)


def _auc():
    area = F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2.0))
    pairs = F.max("_tp_total").cast("double") * F.max("_fp_total")
    return ratio(area, pairs)


def _ap():
    step = F.col("_pos") * F.col("_tp") / F.nullif(F.col("_tp") + F.col("_fp"), F.lit(0))
    return ratio(F.sum(step), F.max("_tp_total"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "p_final",
            label: str = "label") -> DataFrame:
    """Area under the ROC curve; tied scores count half.  Null with one class only."""
    return _by_score(df, by, score, label).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), score: str = "p_final",
                      label: str = "label") -> DataFrame:
    """Precision summed over recall steps (no interpolation)."""
    return _by_score(df, by, score, label).groupBy(*by).agg(_ap().alias("pr_auc"))


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), score: str = "p_final",
                    label: str = "label") -> DataFrame:
    """Both areas from one ordered pass."""
    return _by_score(df, by, score, label).groupBy(*by).agg(
        _auc().alias("roc_auc"), _ap().alias("pr_auc"))


SKETCH_K = 400     # items of a level of a latency sketch
SKETCH_ERROR = 0.01  # of a rank, as a share of the rows so far, at that size


def running_quality(df: DataFrame, every: int = 500, order: Sequence[str] = ("ts", "event_id"),
                    latency: str | None = "processing_latency_ms",
                    guess: str = "is_anomaly", exact: bool = False) -> DataFrame:
    """Cumulative quality after every ``every`` rows and after the last one.

    Rows collapse to one row per report step before any running sum. Cumulative latency
    quantiles come from one mergeable sketch per step, with a rank error of about SKETCH_ERROR.
    ``exact`` takes interpolated quantiles of whole milliseconds instead, from counts that grow
    with steps times distinct values; choose ``every`` in proportion to the table there.
    """
    placed = ordered_sequence(df, order, start=1, name="_n")
    step = F.floor((F.col("_n") - 1) / F.lit(every)).cast("long")
    placed = placed.withColumn("_step", step)
    label, hit = F.col("label") == 1, F.col(guess) == 1
    counted = [
        F.max("_n").alias("processed"), F.count("*").alias("_rows"),
        F.count_if(label & hit).alias("_tp"), F.count_if(~label & hit).alias("_fp"),
        F.count_if(label & ~hit).alias("_fn"), F.count_if(~label & ~hit).alias("_tn"),
        F.count_if(F.col("escalated").cast("int") == 1).alias("_up")]
    sketched = latency is not None and not exact
    if sketched:
        counted += [F.count(latency).alias("_timed"), F.kll_sketch_agg_double(
            F.col(latency).cast("double"), SKETCH_K).alias("_sketch")]
    cells = placed.groupBy("_step").agg(*counted)
    if sketched:
        cells = written(cells, "quality_steps")
    sums = {"_tp": "tp", "_fp": "fp", "_fn": "fn", "_tn": "tn", "_up": "escalated"}
    run = running_totals(cells.drop("_timed", "_sketch"), ["_step"], sums)
    report = detection_metrics(run, zero_division=0.0).select(
        "_step", "processed", "precision", "recall", "f1",
        (F.col("escalated") * 100.0 / F.col("processed")).alias("escalated_pct"))
    if latency is None:
        return report.drop("_step")
    times = (running_latency(placed, latency, {"p50": 0.5, "p95": 0.95}) if exact
             else _sketched_latency(cells, {"p50": 0.5, "p95": 0.95}))
    return report.join(times, "_step", "left").drop("_step")


def _sketched_latency(cells: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles over all rows up to each step, from sketches merged along the steps.

    Steps are dealt into about as many blocks as a block has steps. A block's sketches are
    merged in order, the blocks' sketches too, and each step takes the blocks before its own
    along, so a task never sees more than the root of the number of steps.
    """
    last = cells.agg(F.max("_step")).first()[0]
    width = max(1, math.isqrt((last or 0) + 1))
    own = cells.where("_timed > 0").select(
        "_step", "_sketch", F.floor(F.col("_step") / width).cast("long").alias("_block"))
    blocks = own.groupBy("_block").agg(F.kll_merge_agg_double("_sketch").alias("_whole"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = blocks.select((F.lead("_block").over(Window.orderBy("_block"))).alias("_block"),
                         F.kll_merge_agg_double("_whole").over(before).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    merged = own.select("_step", "_block", F.kll_merge_agg_double("_sketch").over(inside).alias(
        "_inside")).join(upto, "_block", "left").withColumn("_all", F.coalesce(
            F.kll_sketch_merge_double("_inside", "_before"), "_inside"))
    return merged.select("_step", *[
        F.kll_sketch_get_quantile_double("_all", F.lit(q)).alias(n) for n, q in probs.items()])


def running_latency(placed: DataFrame, latency: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles over all rows up to each step (column ``_step``)."""
    counts = placed.where(F.col(latency).isNotNull()).groupBy(latency, "_step").agg(
        F.count("*").alias("_c"))
    last = placed.agg(F.max("_step")).scalar()
    # One empty row per value and step from the value's first step on; the running sum
    # takes the counts of the same step along.
    steps = counts.groupBy(latency).agg(F.min("_step").alias("_from")).withColumn("_last", last)
    empty = steps.select(latency, F.explode(F.sequence("_from", "_last")).alias("_step"),
                         F.lit(0).cast("long").alias("_c"), F.lit(True).alias("_empty"))
    line = Window.partitionBy(latency).orderBy("_step").rangeBetween(
        Window.unboundedPreceding, 0)
    upto = empty.unionByName(counts.withColumn("_empty", F.lit(False))).withColumn(
        "_c", F.sum("_c").over(line)).where("_empty")
    return upto.groupBy("_step").agg(*[
        F.percentile(latency, q, F.col("_c")).alias(n) for n, q in probs.items()])
