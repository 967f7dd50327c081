"""The scoring flow: readings, features, two detectors, gate, stronger model, decision.

Every step is a projection except the feature window, so a batch run has one shuffle
and a streaming run one stateful operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.calibration import Calibration
from sieveguard.detectors.fallback import BatchScorer, selective_override, tree_scorer
from sieveguard.detectors.forest import score_forest
from sieveguard.detectors.reconstruction import ReconstructionModel, score_reconstruction
from sieveguard.functions.columns import (
    decide, default_identity, processing_latency, reason_code, route_labels, uncertainty_gate)


@dataclass
class Models:
    """Fitted detectors of a deployment."""
    forest: DataFrame
    forest_calibration: Calibration
    reconstruction: ReconstructionModel
    reconstruction_calibration: Calibration
    fallback: DataFrame | None = None

    def probabilities(self, features: DataFrame) -> DataFrame:
        """``p_if`` from the negated forest score, ``p_ae`` from the error."""
        both = score_reconstruction(score_forest(features, self.forest), self.reconstruction)
        return both.withColumns({
            "p_if": self.forest_calibration.prob(-F.col("if_score")),
            "p_ae": self.reconstruction_calibration.prob("reconstruction_error"),
        }).drop("if_score", "reconstruction_error")

    def scorer(self) -> BatchScorer:
        if self.fallback is None:
            raise ValueError("no fallback model was fitted")
        return tree_scorer(self.fallback)


def decide_records(features: DataFrame, probabilities: Callable[[DataFrame], DataFrame],
                   scorer: Column | BatchScorer | None, mode: str = S.MODE_SELECTIVE,
                   processed_at: Column | None = None) -> DataFrame:
    """Feature rows (batch or stream) to decision records.

    ``probabilities`` adds ``p_if`` and ``p_ae``; ``scorer`` is the stronger model, a
    column expression or a batch function over the twelve inputs.
    """
    if mode not in (S.MODE_FAST, S.MODE_SELECTIVE):
        raise ValueError("mode must be fast or selective")
    now = F.unix_millis(F.current_timestamp()) if processed_at is None else processed_at
    named = default_identity(features, F.unix_millis(F.current_timestamp()))
    gated = uncertainty_gate(probabilities(named)).withColumn("processed_at_epoch_ms", now)
    decided = decide(selective_override(gated, scorer, mode))
    return processing_latency(route_labels(reason_code(decided), mode))


def stream_score(features: DataFrame, models: Models, mode: str = S.MODE_SELECTIVE) -> DataFrame:
    scorer = models.scorer() if mode == S.MODE_SELECTIVE else None
    return decide_records(features, models.probabilities, scorer, mode)


def both_modes(features: DataFrame, probabilities: Callable[[DataFrame], DataFrame],
               scorer: Column | BatchScorer, processed_at: Column | None = None) -> DataFrame:
    """Records of fast and selective mode from one scan and one feature window.

    Each row is scored once and then written twice, with the columns of its mode.
    """
    one = decide_records(features, probabilities, scorer, S.MODE_SELECTIVE, processed_at)
    two = one.withColumn("_mode", F.explode(F.array(F.lit(S.MODE_FAST), F.lit(S.MODE_SELECTIVE))))
    fast = F.col("_mode") == S.MODE_FAST
    two = two.withColumns({
        "p_final": F.when(fast, 0.5 * (F.col("p_if") + F.col("p_ae"))).otherwise(F.col("p_final")),
        "escalated": ~fast & F.col("escalated"),
    })
    routed = route_labels(reason_code(decide(two)), S.MODE_SELECTIVE)
    return routed.withColumn("system_name", F.col("_mode")).drop("_mode")
