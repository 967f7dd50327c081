import json
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors import forest as IF
from sieveguard.detectors.calibration import Calibration, fit_platt, load_calibration
from sieveguard.detectors.external import external_decision
from sieveguard.detectors.fallback import (
    batch_decide, column_append, fit_fallback, score_fallback, tree_scorer)
from sieveguard.detectors.reconstruction import (
    ReconstructionModel, fit_reconstruction, score_reconstruction)
from sieveguard.detectors.trees import leaf_sum, tree_arrays


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1500, 10))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, .1, 1500)
    odd = np.arange(1500) % 50 == 0
    x[odd] += rng.choice([-6, 6], (odd.sum(), 10))
    data = pd.DataFrame(x, columns=S.FEATURES)
    data["event_id"] = [f"e{i}" for i in range(1500)]
    data["label"] = odd.astype(int)
    data["p_if"], data["p_ae"] = rng.random(1500), rng.random(1500)
    data["uncertain"] = rng.random(1500) < .4
    return spark.createDataFrame(data)


def test_forest_separates_and_is_repeatable(spark, table):
    a = IF.fit_forest(table, trees=40, samples=128)
    b = IF.fit_forest(table.repartition(7), trees=40, samples=128)
    key = ["tree", "node", "feature", "threshold", "left", "right", "value", "offset"]
    assert a.orderBy("tree", "node").select(*key).collect() == \
        b.orderBy("tree", "node").select(*key).collect()
    got = IF.score_forest(table, a).groupBy("label").agg(F.avg("if_score").alias("m")).collect()
    means = {r["label"]: r["m"] for r in got}
    assert means[1] < 0 < means[0]
    share = IF.score_forest(table, a).where("if_score < 0").count() / 1500
    assert share == pytest.approx(.03, abs=.005)
    assert IF.fit_forest(table, trees=40, samples=128, seed=1).first()["offset"] != a.first()["offset"]


def test_forest_depth_and_leaf_values(spark, table):
    nodes = IF.fit_forest(table, trees=5, samples=64).toPandas()
    leaves = nodes[nodes.left == nodes.node]
    assert nodes.groupby("tree").size().max() <= 2 * 64 - 1
    assert leaves.value.max() <= 6 + IF.mean_path(64)
    assert IF.mean_path(512) == pytest.approx(
        2 * (math.log(511) + .5772156649) - 2 * 511 / 512)


@pytest.mark.parametrize("rows", [60, 3_000, 300_000])
def test_samples_follow_one_rule(spark, rows):
    """The rows with the smallest draws of each tree, at every table size and with repeats."""
    df = spark.range(rows).select(F.col("id").alias("event_id"), *[
        (F.col("id") % (7 + i)).cast("double").alias(c) for i, c in enumerate(S.FEATURES)])
    twice = df.unionByName(df.where("event_id % 3 = 0"))
    picked = IF.draw_samples(twice, 3, 100, 42, "event_id").select("tree", "event_id").toPandas()
    for tree in range(3):
        draw = F.pmod(F.xxhash64("event_id", F.lit(42), F.lit(tree)), F.lit(IF.HASH_SPAN))
        want = [r["event_id"] for r in df.orderBy(draw, "event_id").limit(100).collect()]
        assert sorted(picked[picked.tree == tree].event_id) == sorted(want)


def test_short_draws_are_widened(spark, monkeypatch):
    df = spark.range(20_000).select(F.col("id").alias("event_id"))
    monkeypatch.setattr(IF, "first_share", lambda samples, total: samples / 4 / total)
    picked = IF.draw_samples(df, 4, 100, 1, "event_id")
    assert {r["count"] for r in picked.groupBy("tree").count().collect()} == {100}


def test_tree_walk_matches_a_recursive_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(256, 10))
    nodes = IF.grow_tree(x, 0, 9, 8)
    def walk(row):
        at, depth = 0, 0
        while nodes.left[at] != at:
            at = nodes.left[at] if row[nodes.feature[at]] < nodes.threshold[at] else nodes.right[at]
        return nodes.value[at]
    assert leaf_sum(tree_arrays(nodes), x, True) == pytest.approx([walk(r) for r in x])


def test_components_match_numpy(spark, table):
    model = fit_reconstruction(table)
    x = table.select(*S.FEATURES).toPandas().to_numpy()
    z = (x - np.array(model.means)) / np.array(model.stds)
    _, _, vt = np.linalg.svd(z - z.mean(axis=0))
    want = ((z - z @ vt[:3].T @ vt[:3]) ** 2).mean(axis=1)
    got = score_reconstruction(table, model).select("reconstruction_error").toPandas()
    assert got["reconstruction_error"].to_numpy() == pytest.approx(want, abs=1e-6)
    again = ReconstructionModel.from_json(model.to_json())
    assert again == model


def test_calibration_is_the_penalised_optimum(spark, table):
    scored = table.withColumn("s", F.col("temperature") + F.col("label") * 1.0)
    fit = fit_platt(scored, "s")
    data = scored.select("s", "label").toPandas()
    y, s = data.label.to_numpy(), data.s.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    def loss(a, b):
        z = (2 * y - 1) * (a * s + b)
        return (w * np.log1p(np.exp(-z))).sum() + .5 * a * a
    best = loss(fit.coef, fit.intercept)
    for da, db in ((.01, 0), (-.01, 0), (0, .01), (0, -.01)):
        assert loss(fit.coef + da, fit.intercept + db) > best
    with pytest.raises(ValueError):
        fit_platt(scored.where("label = 0"), "s")


def test_boosted_trees_match_the_library_model(spark, table):
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.functions import vector_to_array
    import sieveguard.detectors.fallback as FB
    paths = []
    original = FB.scratch_path
    FB.scratch_path = lambda s, n: paths.append(original(s, n)) or paths[-1]
    try:
        nodes = fit_fallback(table, trees=5, depth=3)
    finally:
        FB.scratch_path = original
    model = GBTClassificationModel.load(paths[0])
    want = model.transform(column_append(table)).select(
        "event_id", vector_to_array("probability")[1].alias("p"))
    got = score_fallback(table, nodes, only_uncertain=False).select("event_id", "p_fallback")
    both = got.join(want, "event_id").toPandas()
    assert both.p_fallback.to_numpy() == pytest.approx(both.p.to_numpy(), abs=1e-9)
    part = score_fallback(table, nodes)
    assert part.where("uncertain and p_fallback is null").count() == 0
    assert part.where("not uncertain and p_fallback is not null").count() == 0
    decided = batch_decide(table, "fallback", tree_scorer(nodes))
    assert decided.where("(p_anomaly >= 0.5) <> (decision = 'ANOMALY')").count() == 0


def test_batch_decide_arguments(spark, table):
    with pytest.raises(ValueError):
        batch_decide(table, "fallback")
    with pytest.raises(ValueError):
        batch_decide(table, "other")


def test_calibration_files(spark, tmp_path):
    good = {"coef": 2.0, "intercept": -1.0, "features": S.FEATURES, "means": [0.0] * 10,
            "stds": [1.0] * 10}
    def put(name, **change):
        path = tmp_path / name
        path.write_text(json.dumps({**good, **change}, indent=2))
        return str(path)
    assert load_calibration(spark, put("a.json"), needs_scaler=True) == Calibration(
        2.0, -1.0, [0.0] * 10, [1.0] * 10)
    for name, change in (("b.json", {"features": S.FEATURES[::-1]}), ("c.json", {"stds": [1.0]}),
                         ("d.json", {"features": None}), ("e.json", {"coef": None})):
        with pytest.raises(ValueError):
            load_calibration(spark, put(name, **change), needs_scaler=True)


def asked(spark, table):
    return table.withColumns({"moteid": F.lit(1), "epoch": F.lit(2)}).limit(300)


def test_external_failures_become_rows(spark, table):
    def call(requests):
        p = json.loads(requests[0])["p_if"]
        if p < .25:
            raise ConnectionError("no route")
        if p < .5:
            raise KeyError("field")
        if p < .75:
            return []
        return [(200, '{"decision":"ANOMALY","confidence":0.7}')] * len(requests)
    rows = asked(spark, table)
    out = external_decision(rows, call, batch=1, concurrency=4).collect()
    assert len(out) == rows.where("uncertain").count()
    kinds = {r["inference_status"].split(":")[0] for r in out}
    assert kinds == {"FAILED", "REQUEST_ERROR", "INVALID_RESPONSE", "OK"}
    assert all((r["p_final"] is None) == (r["inference_status"] != "OK") for r in out)


def test_one_slow_request_delays_no_other(spark, table):
    rows = asked(spark, table).where("uncertain").limit(30).coalesce(1)
    slowest = rows.first()                                    # asked before all others
    marked = slowest["p_if"]

    def call(requests):
        time.sleep(2.5 if json.loads(requests[0])["p_if"] == marked else 0.01)
        return [(200, json.dumps({"decision": "NORMAL", "confidence": 0.1}))]

    out = external_decision(rows, call, batch=1, concurrency=2).collect()
    times = {r["event_id"]: r["processed_at_epoch_ms"] for r in out}
    assert len(out) == rows.count() and {r["inference_status"] for r in out} == {"OK"}
    late = times.pop(slowest["event_id"])
    assert late - max(times.values()) > 500


def test_failed_requests_are_tried_again_within_their_deadline(spark, table, tmp_path):
    rows = asked(spark, table).where("uncertain").limit(6).coalesce(1)

    def flaky(requests):
        seen = tmp_path / str(abs(hash(requests[0])))
        if not seen.exists():
            seen.touch()
            raise ConnectionError("reset")
        return [(200, json.dumps({"decision": "NORMAL", "confidence": 0.1}))] * len(requests)

    def dead(requests):
        raise ConnectionError("down")

    once = external_decision(rows, flaky, batch=1, retries=1).collect()
    assert {r["inference_status"] for r in once} == {"OK"}
    never = external_decision(rows, dead, batch=2, retries=3).collect()
    assert len(never) == 6 and {r["inference_status"] for r in never} == {"FAILED:down"}


def test_external_timeout(spark, table):
    def slow(requests):
        time.sleep(2.0)
        return [(200, "{}")] * len(requests)
    rows = asked(spark, table).where("uncertain").limit(3).coalesce(1)
    out = external_decision(rows, slow, timeout_s=.2).collect()
    assert [r["inference_status"] for r in out] == ["TIMEOUT"] * 3
    with pytest.raises(ValueError):
        external_decision(rows, slow, batch=1000)
