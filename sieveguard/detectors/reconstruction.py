"""Reconstruction detector: how badly a small code of the features restores them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.functions.columns import clean, clean_features, standardize
from sieveguard.operators.aggregates import scaler_stats


@dataclass
class ReconstructionModel:
    """Scaler and principal components (k x 10)."""
    means: list[float]
    stds: list[float]
    components: list[list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "ReconstructionModel":
        return ReconstructionModel(**json.loads(text))


def fit_reconstruction(df: DataFrame, k: int = 3) -> ReconstructionModel:
    """Fit on clean rows: one pass for the scaler, one for the components."""
    base = clean_features(df.select(*S.FEATURES))
    stats = {r["feature"]: r for r in scaler_stats(base).collect()}
    means = [float(stats[c]["mean"]) for c in S.FEATURES]
    stds = [float(stats[c]["std"]) for c in S.FEATURES]
    scaled = standardize(base, means, stds).select(*[f"std_{c}" for c in S.FEATURES])
    vectors = VectorAssembler(inputCols=scaled.columns, outputCol="x").transform(scaled)
    pc = PCA(k=k, inputCol="x", outputCol="y").fit(vectors).pc.toArray()
    return ReconstructionModel(means, stds, pc.T.tolist())


def score_reconstruction(df: DataFrame, model: ReconstructionModel,
                         name: str = "reconstruction_error") -> DataFrame:
    """Adds the mean squared error over the ten standardised features.

    Components are orthonormal, so their error is a sum of squares less the squares of
    the code: plain column arithmetic.
    """
    z = [(clean(c) - F.lit(m)) / F.lit(s)
         for c, m, s in zip(S.FEATURES, model.means, model.stds)]
    whole = sum((x * x for x in z[1:]), z[0] * z[0])
    kept = F.lit(0.0)
    for row in model.components:
        dot = sum((F.lit(float(w)) * x for w, x in zip(row[1:], z[1:])),
                  F.lit(float(row[0])) * z[0])
        kept = kept + dot * dot
    return df.withColumn(name, F.greatest(F.lit(0.0), whole - kept) / float(len(z)))
