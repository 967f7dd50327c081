import math

from pyspark.sql import functions as F

from conftest import make_readings
from sieveguard.plans.flow import stream_score
from sieveguard.plans.study import (
    evaluate_models, fit_models, load_models, prepare_splits, save_models)
from test_streaming import labelled

ORDER = ("ts", "seq")


def test_study_from_readings_to_saved_models(spark, tmp_path):
    rows = [(i % 5, i, 20 + 2 * math.sin(i / 40) + (i * 7919 % 97) / 300,
             2.6 + (i * 104729 % 89) / 5000) for i in range(6000)]
    splits = prepare_splits(make_readings(spark, rows), order=ORDER, limit=5500)
    sizes = {k: v.count() for k, v in splits.items()}
    assert sizes == {"train": 3300, "val": 1100, "test": 1100}
    assert splits["train"].agg(F.sum("label")).first()[0] == 0
    models = fit_models(splits)
    got = {r["system"]: r for r in evaluate_models(splits, models).collect()}
    assert got["A"]["roc_auc"] > .7 and got["B"]["roc_auc"] > .7
    save_models(models, str(tmp_path / "m"))
    again = load_models(spark, str(tmp_path / "m"))
    assert (again.fallback is None) == (models.fallback is None)
    mode = "fast" if models.fallback is None else "selective"
    rows = labelled(splits["test"].drop("label", "anomaly_type", "split"))
    a = {r["event_id"]: r["p_final"] for r in stream_score(rows, models, mode).collect()}
    b = {r["event_id"]: r["p_final"] for r in stream_score(rows, again, mode).collect()}
    assert a == b and len(a) == 1100
