"""Trained detectors and external decisions."""

from __future__ import annotations

import json
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.calibration import fit_platt, loss_terms
from sieveguard.detectors.external import external_decision
from sieveguard.detectors.fallback import DEPTH, fit_fallback, score_fallback
from sieveguard.detectors.forest import fit_forest, score_forest
from sieveguard.detectors.reconstruction import (
    ReconstructionModel, fit_reconstruction, score_reconstruction)
from sieveguard.functions.columns import clean_features, standardize
from sieveguard.operators.aggregates import class_weights
from sieveguard.plans.study import evaluate_models, fit_models, prepare_splits
from sieveguard.scratch import written
from workload.base import (
    ORDER, SQL_SCORED, features, query, readings, rounded, s6, scored, sql)


@query("isolation_forest_fit")
def _(spark, sf):
    return fit_forest(features(spark, sf), unique="seq")


@query("isolation_forest_score")
def _(spark, sf):
    rows = features(spark, sf)
    nodes = fit_forest(rows, unique="seq")
    return score_forest(rows, nodes).select("seq", "if_score")


@query("reconstruction_fit")
def _(spark, sf):
    model = fit_reconstruction(features(spark, sf))
    rows = [(m, c, float(w)) for m, line in enumerate(model.components)
            for c, w in zip(S.FEATURES, line)]
    return spark.createDataFrame(rows, "component int, feature string, weight double")


# Two orthonormal example components and an example scaler.
_MODEL = ReconstructionModel(
    means=[10.0] * 10, stds=[4.0] * 10,
    components=[[0.6, 0.8, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0.8, 0.6, 0, 0]])


def _reconstruction_sql() -> str:
    z = [f"(({c}) - 10e0) / 4e0" for c in S.FEATURES]
    whole = " + ".join(f"({x}) * ({x})" for x in z)
    one = f"(6e-1 * ({z[0]}) + 8e-1 * ({z[1]}))"
    two = f"(8e-1 * ({z[6]}) + 6e-1 * ({z[7]}))"
    return s6(f"({whole} - {one} * {one} - {two} * {two}) / 10e0", "reconstruction_error")


@query("reconstruction_score", sql(SQL_SCORED, f"select seq, {_reconstruction_sql()} from g"))
def _(spark, sf):
    out = score_reconstruction(scored(spark, sf), _MODEL)
    return rounded(out.select("seq", "reconstruction_error"), "reconstruction_error")


@query("platt_fit")
def _(spark, sf):
    fit = fit_platt(scored(spark, sf).withColumn("_s", F.abs("z_temp_15m")), "_s")
    return spark.createDataFrame([(fit.coef, fit.intercept)], "coef double, intercept double")


@query("platt_conditions", sql(SQL_SCORED, """
select 'coef' as condition, count(*) as rows, 0e0 as residual from g
union all select 'intercept', count(*), 0e0 from g"""))
def _(spark, sf):
    """Slopes of the penalised loss at the fitted values, as shares of the rows' weight."""
    rows = scored(spark, sf).select(F.abs("z_temp_15m").alias("_s"), "label")
    fit, w = fit_platt(rows, "_s"), class_weights(rows).first()
    sums = loss_terms(rows, fit.coef, fit.intercept, w["weight_anomaly"], w["weight_normal"])
    off = [("coef", sums["g_s"] + fit.coef), ("intercept", sums["g"])]
    return spark.createDataFrame([(n, w["n"], round(x / w["n"], 6) + 0.0) for n, x in off],
                                 "condition string, rows long, residual double")


@query("reconstruction_conditions", """
select component, 0e0 as length_off, 0e0 as angle_off, 0e0 as axis_off, true as descending
from (values (0), (1), (2)) t(component)""")
def _(spark, sf):
    """The fitted components are orthonormal axes of the scaled features' covariance, the
    largest first: what is off, rounded."""
    rows = features(spark, sf)
    model = fit_reconstruction(rows)
    scaled = standardize(clean_features(rows.select(*S.FEATURES)), model.means, model.stds)
    names = [f"std_{c}" for c in S.FEATURES]
    sums = scaled.agg(*[F.covar_samp(a, b) for a in names for b in names]).first()
    spread, axes = np.array(sums).reshape(10, 10), np.array(model.components)
    turned = axes @ spread
    sizes = (turned * axes).sum(axis=1)
    out = []
    for i, axis in enumerate(axes):
        others = np.delete(axes, i, axis=0)
        out.append((i, *[round(float(np.abs(x).max()), 6) for x in (
            axis @ axis - 1, others @ axis, turned[i] - sizes[i] * axis)],
            bool(i == 0 or sizes[i - 1] >= sizes[i])))
    return spark.createDataFrame(out, "component int, length_off double, angle_off double,"
                                      " axis_off double, descending boolean")


@query("fallback_conditions", """
select 50 as trees, 0 as too_deep, 0 as without_leaves, 0 as lost_children, true as first_whole""")
def _(spark, sf):
    """The boosted trees: how many, nodes below the depth allowed, trees whose leaves are not one
    more than their splits, children that are missing, and whether the first weighs 1."""
    nodes = written(fit_fallback(scored(spark, sf)), "fallback_nodes")
    inner = nodes.where("left <> node")
    level = nodes.where("node = 0").select("tree", "node")
    for _ in range(DEPTH):
        found = inner.join(level, ["tree", "node"])
        level = found.select("tree", F.col("left").alias("node")).union(
            found.select("tree", F.col("right").alias("node")))
    deep = inner.join(level, ["tree", "node"]).count()
    shape = nodes.groupBy("tree").agg(
        F.count("*").alias("all"), F.count_if(F.col("left") != F.col("node")).alias("splits"))
    children = inner.select("tree", F.explode(F.array("left", "right")).alias("node"))
    return shape.agg(
        F.count("*").cast("int").alias("trees"), F.lit(deep).cast("int").alias("too_deep"),
        F.count_if(F.col("all") != 2 * F.col("splits") + 1).cast("int").alias("without_leaves"),
        F.lit(children.join(nodes, ["tree", "node"], "left_anti").count()).cast("int")
        .alias("lost_children"),
        F.lit(nodes.where("tree = 0 and left = node").agg(F.max(F.abs("value"))).first()[0] <= 1.0)
        .alias("first_whole"))


@query("fallback_fit")
def _(spark, sf):
    return fit_fallback(scored(spark, sf))


@query("fallback_score")
def _(spark, sf):
    rows = scored(spark, sf)
    nodes = fit_fallback(rows)
    return score_fallback(rows.drop("p_fallback"), nodes).select("seq", "uncertain", "p_fallback")


@query("trained_systems")
def _(spark, sf):
    """Train on the first rows, calibrate on the next, compare all systems on the last."""
    splits = prepare_splits(readings(spark, sf), order=ORDER)
    return evaluate_models(splits, fit_models(splits))


def answer(requests: list[str], limit: float) -> list[tuple[int, str]]:
    """A stand-in for an external model: decides on the forest probability."""
    out = []
    for text in requests:
        body = json.loads(text)
        if body["p_if"] < 0.2:
            out.append((503, "model  busy"))
        else:
            label = "ANOMALY" if body["p_if"] >= limit else "NORMAL"
            out.append((200, json.dumps({"decision": label, "confidence": body["p_if"]})))
    return out


@query("external_decision", sql(SQL_SCORED, f"""
select seq, case when p_if < 2e-1 then 'HTTP_503:model busy' else 'OK' end as inference_status,
  {s6('case when p_if >= 2e-1 then p_if end', 'p_final')},
  case when p_if < 2e-1 then 'UNKNOWN' when p_if >= 4e-1 then 'ANOMALY' else 'NORMAL' end
    as prediction,
  case when p_if >= 2e-1 then case when p_if >= 4e-1 then 1 else 0 end end as is_anomaly,
  'external' as engine from g where uncertain"""))
def _(spark, sf):
    out = external_decision(scored(spark, sf), partial(answer, limit=0.4), concurrency=2)
    return rounded(out.select("seq", "inference_status", "p_final", "prediction", "is_anomaly",
                              "engine"), "p_final")
