"""A whole study: labelled splits, fitted models, their comparison, and saved models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.calibration import Calibration, fit_platt, load_calibration
from sieveguard.detectors.fallback import fit_fallback, score_fallback
from sieveguard.detectors.forest import fit_forest, score_forest
from sieveguard.detectors.reconstruction import (
    ReconstructionModel, fit_reconstruction, score_reconstruction)
from sieveguard.functions.columns import uncertainty_gate
from sieveguard.operators.ordering import take_first
from sieveguard.operators.prepare import ORDER, SPLITS, chronological_split, inject_anomalies
from sieveguard.operators.windows import dual_window_features
from sieveguard.plans.evaluation import evaluate_systems, system_scores
from sieveguard.plans.flow import Models
from sieveguard.scratch import written


def prepare_splits(readings: DataFrame, val_seed: int = 42, test_seed: int = 42,
                   limit: int | None = None, order: Sequence[str] = ORDER,
                   key: Sequence[str] = ("moteid",), scope: str = "global"
                   ) -> dict[str, DataFrame]:
    """Feature tables of the three splits in time: clean training rows, validation and
    test rows with injected anomalies.  Windows do not reach across splits."""
    rows = readings if limit is None else take_first(readings, order, limit)
    rows = rows.withColumns({"label": F.lit(0), "anomaly_type": F.lit("NORMAL")})
    split = chronological_split(rows, order=order)
    out = {}
    for name, seed in zip(SPLITS, (None, val_seed, test_seed)):
        part = split.where(F.col("split") == name)
        if seed is not None:
            part = inject_anomalies(part, seed, scope=scope, order=order, key=key)
        out[name] = written(dual_window_features(part, key, order), name)
    return out


def fit_models(splits: dict[str, DataFrame], unique: str = "event_id",
               seed: int = 42) -> Models:
    """Detectors from the training split; calibrations and the stronger model from the
    validation split.  Without both classes among its uncertain rows no stronger model is
    fitted."""
    forest = fit_forest(splits["train"], seed=seed, unique=unique)
    net = fit_reconstruction(splits["train"])
    raw = score_reconstruction(score_forest(splits["val"], forest), net)
    raw = written(raw.withColumn("_negated", -F.col("if_score")), "calibrate")
    models = Models(forest, fit_platt(raw, "_negated"), net,
                    fit_platt(raw, "reconstruction_error"))
    gated = uncertainty_gate(raw.withColumns({
        "p_if": models.forest_calibration.prob("_negated"),
        "p_ae": models.reconstruction_calibration.prob("reconstruction_error")}))
    classes = gated.where("uncertain").agg(F.min("label"), F.max("label")).first()
    if tuple(classes) == (0, 1):
        models.fallback = fit_fallback(gated, seed=seed)
    return models


def evaluate_models(splits: dict[str, DataFrame], models: Models) -> DataFrame:
    """Quality of the detectors, their mean and the selective system on the test split."""
    rows = uncertainty_gate(models.probabilities(splits["test"]))
    strong = None
    if models.fallback is not None:
        rows, strong = score_fallback(rows, models.fallback), "p_fallback"
    rows = written(rows, "test_scores")
    return evaluate_systems(rows, system_scores(rows, strong))


def _save_calibration(spark: SparkSession, c: Calibration, path: str) -> None:
    row = [(c.coef, c.intercept, list(S.FEATURES))]
    spark.createDataFrame(row, "coef double, intercept double, features array<string>").coalesce(
        1).write.mode("overwrite").json(path)


def save_models(models: Models, path: str) -> None:
    """Node tables as Parquet, calibrations and the reconstruction model as JSON."""
    spark = models.forest.sparkSession
    models.forest.write.mode("overwrite").parquet(f"{path}/forest")
    if models.fallback is not None:
        models.fallback.write.mode("overwrite").parquet(f"{path}/fallback")
    _save_calibration(spark, models.forest_calibration, f"{path}/forest_calibration")
    _save_calibration(spark, models.reconstruction_calibration,
                      f"{path}/reconstruction_calibration")
    text = [(models.reconstruction.to_json(), models.fallback is not None)]
    spark.createDataFrame(text, "model string, has_fallback boolean").coalesce(1).write.mode(
        "overwrite").json(f"{path}/reconstruction")


def load_models(spark: SparkSession, path: str) -> Models:
    saved = spark.read.schema("model string, has_fallback boolean").json(
        f"{path}/reconstruction").first()
    return Models(
        spark.read.parquet(f"{path}/forest"),
        load_calibration(spark, f"{path}/forest_calibration"),
        ReconstructionModel.from_json(saved["model"]),
        load_calibration(spark, f"{path}/reconstruction_calibration"),
        spark.read.parquet(f"{path}/fallback") if saved["has_fallback"] else None)
