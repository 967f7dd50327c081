"""Probability calibration of a raw score, and calibration files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard import schema as S
from sieveguard.functions.columns import calibrated_prob
from sieveguard.operators.aggregates import class_weights
from sieveguard.scratch import written


@dataclass
class Calibration:
    coef: float
    intercept: float
    means: list[float] | None = None
    stds: list[float] | None = None

    def prob(self, score: Column | str) -> Column:
        return calibrated_prob(score, self.coef, self.intercept)


NEWTON_STEPS, NEWTON_TOLERANCE = 60, 1e-12


def fit_platt(df: DataFrame, score: str, label: str = "label") -> Calibration:
    """Logistic fit on one score with balanced classes and a unit ridge penalty on its weight.

    Newton steps on the convex loss: each takes loss, gradient and curvature from one
    aggregation over the written scores, and is halved while it does not lower the loss.
    """
    rows = written(df.select(F.col(score).cast("double").alias("_s"),
                             F.col(label).cast("int").alias("label")).dropna(), "calibration")
    w = class_weights(rows).first()
    if not w["pos"] or not w["neg"]:
        raise ValueError("calibration needs both classes")
    now, loss = (0.0, 0.0), float("inf")
    move = (0.0, 0.0)
    for _ in range(NEWTON_STEPS):
        tried = (now[0] + move[0], now[1] + move[1])
        sums = loss_terms(rows, *tried, w["weight_anomaly"], w["weight_normal"])
        if sums["loss"] > loss:
            move = (move[0] / 2, move[1] / 2)
        else:
            now, loss = tried, sums["loss"]
            a, b, d = sums["h_ss"] + 1.0, sums["h_s"], sums["h"]
            g, k = sums["g_s"] + now[0], sums["g"]
            det = a * d - b * b
            move = ((b * k - d * g) / det, (b * g - a * k) / det)
        if max(map(abs, move)) <= NEWTON_TOLERANCE * (1.0 + max(map(abs, now))):
            break
    return Calibration(*now)


def loss_terms(rows: DataFrame, coef: float, intercept: float, positive: float,
               negative: float) -> Row:
    """Weighted logistic loss (with half the squared weight), its gradient and curvature without
    the penalty, of ``rows(_s, label)``."""
    margin = F.lit(coef) * F.col("_s") + F.lit(intercept)
    weight = F.when(F.col("label") == 1, positive).otherwise(negative)
    side = F.when(F.col("label") == 1, margin).otherwise(-margin)
    # log(1 + exp(-side)) without overflow
    loss = F.log1p(F.exp(-F.abs(side))) + F.greatest(-side, F.lit(0.0))
    prob = 1.0 / (1.0 + F.exp(-margin))
    slope = weight * (prob - F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    bend = weight * prob * (1.0 - prob)
    s = F.col("_s")
    return rows.agg(
        (F.sum(weight * loss) + coef * coef / 2.0).alias("loss"), F.sum(slope).alias("g"),
        F.sum(slope * s).alias("g_s"), F.sum(bend).alias("h"), F.sum(bend * s).alias("h_s"),
        F.sum(bend * s * s).alias("h_ss")).first()


CALIBRATION = T.StructType([
    T.StructField("coef", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("stds", T.ArrayType(T.DoubleType())),
    T.StructField("features", T.ArrayType(T.StringType())),
])


def load_calibration(spark: SparkSession, path: str, feature_order: list[str] | None = None,
                     needs_scaler: bool = False) -> Calibration:
    """Read one calibration file and check its feature contract."""
    wanted = list(feature_order or S.FEATURES)
    rows = spark.read.schema(CALIBRATION).option("multiLine", True).option(
        "mode", "FAILFAST").json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one calibration record")
    row = rows[0]
    if row["features"] != wanted:
        raise ValueError(f"{path}: feature order {row['features']} is not {wanted}")
    if row["coef"] is None or row["intercept"] is None:
        raise ValueError(f"{path}: coef and intercept are required")
    if needs_scaler and (len(row["means"] or []) != len(wanted)
                         or len(row["stds"] or []) != len(wanted)):
        raise ValueError(f"{path}: expected {len(wanted)} means and deviations")
    return Calibration(row["coef"], row["intercept"], row["means"], row["stds"])


def params_table(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Calibration parameters as rows (model, feature, mean, std, coef, intercept)."""
    one = spark.read.schema(CALIBRATION).option("multiLine", True).json(path)
    zipped = F.arrays_zip("features", "means", "stds")
    return one.select(F.lit(model).alias("model"), "coef", "intercept",
                      F.explode(zipped).alias("z")).select(
        "model", F.col("z.features").alias("feature"), F.col("z.means").alias("mean"),
        F.col("z.stds").alias("std"), "coef", "intercept")


def params_join(long: DataFrame, params: DataFrame) -> DataFrame:
    """Attach per-feature parameters to (feature, value) rows; one row per feature.

    No hint: the planner broadcasts the parameters by their size.
    """
    return long.join(params, "feature")
