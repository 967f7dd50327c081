"""The stronger model: boosted trees, trained on and applied to uncertain rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.trees import collect_trees, leaf_sum, matrix
from sieveguard.functions.columns import clean, ensemble_mean
from sieveguard.operators.aggregates import class_weights
from sieveguard.scratch import scratch_path, written

INPUTS = [*S.FEATURES, "p_if", "p_ae"]
MAX_NODES = 200_000

# Size and learning rate of the boosted trees.
TREES, DEPTH, STEP = 50, 4, 0.08

BatchScorer = Callable[[np.ndarray], np.ndarray]


def column_append(df: DataFrame, name: str = "inputs") -> DataFrame:
    """The ten features and both probabilities as one vector of twelve."""
    return VectorAssembler(inputCols=INPUTS, outputCol=name, handleInvalid="error").transform(
        df.withColumns({c: clean(c) for c in INPUTS}))


def fit_fallback(df: DataFrame, trees: int = TREES, depth: int = DEPTH, step: float = STEP,
                 seed: int = 42) -> DataFrame:
    """Node table of boosted trees fitted on the uncertain rows of ``df``.

    Leaf values carry the tree weight, so a row's score is the sum of its leaves.
    """
    spark = df.sparkSession
    chosen = df.where("uncertain").select(*INPUTS, F.col("label").cast("double").alias("label"))
    rows = written(chosen, "fallback_train")
    w = class_weights(rows).first()
    if not w["pos"] or not w["neg"]:
        raise ValueError("the uncertain rows must hold both classes")
    weighted = column_append(rows).withColumn(
        "_w", F.when(F.col("label") == 1, w["scale_pos_weight"]).otherwise(1.0))
    model = GBTClassifier(featuresCol="inputs", labelCol="label", weightCol="_w", maxIter=trees,
                          maxDepth=depth, stepSize=step, seed=seed).fit(weighted)
    path = scratch_path(spark, "fallback_model")
    model.save(path)
    weights = F.array(*[F.lit(float(x)) for x in model.treeWeights])
    node, leaf = F.col("nodeData"), F.col("nodeData.leftChild") < 0
    mine = node["id"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), mine.alias("node"),
        F.when(leaf, 0).otherwise(node["split"]["featureIndex"]).alias("feature"),
        F.when(leaf, 0.0).otherwise(
            F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)))
        .alias("threshold"),
        F.when(leaf, mine).otherwise(node["leftChild"]).alias("left"),
        F.when(leaf, mine).otherwise(node["rightChild"]).alias("right"),
        (node["prediction"] * F.element_at(weights, F.col("treeID") + 1)).alias("value"))


def tree_scorer(nodes: DataFrame) -> BatchScorer:
    """Anomaly probability of a batch from a boosted node table."""
    forest = collect_trees(nodes, MAX_NODES)
    return lambda x: 1.0 / (1.0 + np.exp(-2.0 * leaf_sum(forest, x, False)))


def masked_prob(scorer: BatchScorer, mask: Column | str,
                inputs: list[str] | None = None) -> Column:
    """Probability for rows where ``mask`` holds, null elsewhere.

    A conditional expression around a Python function would still send it every row;
    here the function picks the masked rows out of each Arrow batch, so the model sees
    only those.
    """
    mask = F.col(mask) if isinstance(mask, str) else mask

    @F.pandas_udf("double")
    def prob(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for frame, wanted in parts:
            pick = wanted.fillna(False).to_numpy(dtype=bool)
            out = np.full(len(frame), np.nan)
            if pick.any():
                out[pick] = scorer(matrix(frame[pick]))
            yield pd.Series(out).where(pick, None)

    return prob(F.struct(*(inputs or INPUTS)), mask)


def selective_override(df: DataFrame, scorer: Column | BatchScorer,
                       mode: str = S.MODE_SELECTIVE) -> DataFrame:
    """Adds ``p_final`` and ``escalated``.

    In selective mode uncertain rows take the stronger probability: a column expression
    is evaluated lazily inside generated code, a batch function through
    :func:`masked_prob`.  In fast mode the mean stands, and ``uncertain`` stays set.
    """
    mean = ensemble_mean()
    if mode == S.MODE_FAST:
        return df.withColumns({"p_final": mean, "escalated": F.lit(False)})
    if mode != S.MODE_SELECTIVE:
        raise ValueError("mode must be fast or selective")
    if isinstance(scorer, Column):
        final = F.when(F.col("uncertain"), scorer).otherwise(mean)
    else:
        final = F.coalesce(masked_prob(scorer, "uncertain"), mean)
    return df.withColumns({"p_final": final, "escalated": F.col("uncertain")})


def score_fallback(df: DataFrame, nodes: DataFrame, name: str = "p_fallback",
                   only_uncertain: bool = True) -> DataFrame:
    mask = F.col("uncertain") if only_uncertain else F.lit(True)
    return df.withColumn(name, masked_prob(tree_scorer(nodes), mask))


def batch_decide(df: DataFrame, engine: str, scorer: BatchScorer | None = None) -> DataFrame:
    """Decision and probability for every row from one engine.

    ``heuristic`` needs no model; ``fallback`` and ``external`` take a batch scorer over
    the twelve inputs.
    """
    from sieveguard.functions.columns import heuristic_prob
    if engine == "heuristic":
        p = heuristic_prob()
    elif engine in ("fallback", "external"):
        if scorer is None:
            raise ValueError(f"engine {engine} needs a scorer")
        p = masked_prob(scorer, F.lit(True))
    else:
        raise ValueError("engine must be fallback, heuristic or external")
    out = df.withColumn("p_anomaly", p)
    return out.withColumn("decision", F.when(F.col("p_anomaly") >= S.THRESHOLD, "ANOMALY")
                          .otherwise("NORMAL"))
