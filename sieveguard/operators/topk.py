"""Top lists and escalation by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.functions.columns import event_priority, uncertainty_score
from sieveguard.operators.ordering import before_cut, order_cuts, sort_columns, take_first
from sieveguard.scratch import written

NEWEST = ("-processed_at_epoch_ms", "event_id")

# Escalation shares of the sweep.
SWEEP_RATES = (0.0, 0.025, 0.05, 0.10, 0.20, 0.40, 1.00)


def recent_events(df: DataFrame, limit: int = 50) -> DataFrame:
    """The newest rows of an already filtered decision table."""
    if not 1 <= limit <= 250:
        raise ValueError("limit must be between 1 and 250")
    return df.orderBy(*sort_columns(NEWEST)).limit(limit).select(*S.RECENT_COLUMNS)


def attention_list(recent: DataFrame, n: int = 3,
                   order: Sequence[str] = NEWEST) -> DataFrame:
    """The first n rows of a recent list that are not normal, with their label."""
    shown = event_priority(recent).where(F.col("priority") != "normal")
    names = [c for c in order if c.lstrip("-") in recent.columns]
    shown = shown.orderBy(*sort_columns(names)) if names else shown
    return shown.limit(n).select(
        "event_id", "mote", "display_type", F.upper("priority").alias("severity"))


def head_n(df: DataFrame, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return take_first(df, order, n)


def chronological_sort(df: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Global order for output; nothing inside the library depends on it."""
    return df.orderBy(*sort_columns(order))


def escalation_bands(df: DataFrame, rates: Sequence[float] = SWEEP_RATES,
                     unique: str = "event_id", stored: bool = False
                     ) -> tuple[DataFrame, list[int]]:
    """Adds ``uncertainty`` and ``band``: the index of the lowest rate at which the row
    is escalated (``len(rates)`` when none).  Also returns the row count per rate.

    Rates must ascend.  The rank limits come from a rank search, so no row is sorted or
    moved and rows are not multiplied by the number of rates.  The search takes a few
    passes: over ``df`` itself when it is a ``stored`` table, else over a written copy of
    the two columns it needs, so that scoring is not repeated.
    """
    if list(rates) != sorted(rates):
        raise ValueError("rates must ascend")
    scored = df.withColumn("uncertainty", uncertainty_score())
    narrow = scored.select("uncertainty", unique)
    narrow = narrow if stored else written(narrow, "uncertainty")
    total = narrow.count()
    counts = [round(r * total) for r in rates]
    order = ["-uncertainty", unique]
    band = F.lit(len(rates))
    for i, cut in reversed(list(enumerate(order_cuts(narrow, order, counts)))):
        inside = F.lit(True) if cut is None else before_cut(order, cut)
        band = F.when(inside, i).otherwise(band)
    return scored.withColumn("band", band), counts


def escalation_topk(df: DataFrame, rates: Sequence[float] = SWEEP_RATES,
                    unique: str = "event_id") -> DataFrame:
    """The rows escalated at each rate: the top round(rate * n) by uncertainty."""
    banded, _ = escalation_bands(df, rates, unique)
    ladder = F.array(*[F.lit(float(r)) for r in rates])
    return banded.withColumn(
        "rate", F.explode(F.slice(ladder, F.col("band") + 1, F.lit(len(rates))))).drop("band")
