import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.fallback import masked_prob, selective_override
from sieveguard.functions import columns as C


def pairs(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)],
                                 "id int, p_if double, p_ae double")


@pytest.mark.parametrize("rows,expected", [
    ([(.05, .08), (.12, .20), (.01, .30), (.85, .92), (.70, .88), (.99, .99)], False),
    ([(.80, .20), (.20, .80), (.95, .10)], True),
    ([(.48, .49), (.52, .55), (.36, .20), (.20, .64)], True),
    ([(.35, .2), (.2, .35), (.65, .9)], False),  # the margin is open
])
def test_gate(spark, rows, expected):
    got = C.uncertainty_gate(pairs(spark, rows)).select("uncertain").collect()
    assert [r[0] for r in got] == [expected] * len(rows)


def test_decide(spark):
    df = spark.createDataFrame([(None,), (.5,), (.4999,)], "p_final double")
    got = [(r["prediction"], r["is_anomaly"], r["anomaly_score"]) for r in C.decide(df).collect()]
    assert got == [("UNKNOWN", None, 0.0), ("ANOMALY", 1, .5), ("NORMAL", 0, .4999)]


def test_ensemble_mean_of_known_scores(spark):
    df = pairs(spark, [(.978752613, 1.0)]).select(C.ensemble_mean().alias("p"))
    assert df.first()["p"] == pytest.approx(.989376307, abs=1e-9)


def heuristic_row(spark, **values):
    base = {c: 0.0 for c in (*S.FEATURES, "p_if", "p_ae")}
    base.update(values)
    return spark.createDataFrame([base])


def test_heuristic_score(spark):
    row = heuristic_row(spark, z_temp_15m=.2, z_volt_15m=.1, temp_slope_15m=.01,
                        delta_temp_3m=.1, p_if=.45, p_ae=.48)
    p = C.heuristic_score(row).first()["p_heuristic"]
    assert p == pytest.approx(1 / (1 + math.exp(0.073)), abs=1e-4)
    high = heuristic_row(spark, z_temp_15m=3.8, z_volt_15m=-2.9, temp_slope_15m=.25,
                         delta_temp_3m=4.5, p_if=.62, p_ae=.58)
    assert C.heuristic_score(high).first()["p_heuristic"] > .99


def test_sigmoid_is_clipped(spark):
    df = spark.createDataFrame([(1e9,), (-1e9,)], "s double")
    hi, lo = [r[0] for r in df.select(C.calibrated_prob("s", 1, 0)).collect()]
    assert hi == pytest.approx(1 / (1 + math.exp(-25))) and lo > 0


def test_clean(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.5,)], "x double")
    assert [r[0] for r in df.select(C.clean("x")).collect()] == [0.0, 0.0, 0.0, 2.5]


def test_default_identity(spark):
    df = spark.createDataFrame(
        [(None, "", 0, 4, 9), ("  ", None, -5, 4, 9), ("run", "e1", 77, 4, 9)],
        "run_id string, event_id string, sent_at_epoch_ms long, moteid int, epoch int")
    got = [(r["run_id"], r["event_id"], r["sent_at_epoch_ms"])
           for r in C.default_identity(df, 123).collect()]
    assert got == [("manual", "manual:4:9", 123), ("manual", "manual:4:9", 123), ("run", "e1", 77)]


def test_reason_codes(spark):
    rows = [(.4, True, True), (.4, False, False), (.6, True, True), (.6, True, False),
            (.6, False, False)]
    df = spark.createDataFrame(rows, "p_final double, escalated boolean, disagreement boolean")
    assert [r["anomaly_reasons"] for r in C.reason_code(df).collect()] == [
        "FALLBACK_NORMAL", "NORMAL", "FALLBACK_AFTER_DISAGREEMENT",
        "FALLBACK_AFTER_MARGIN_UNCERTAINTY", "FAST_PATH_ANOMALY"]


def test_fast_mode_keeps_uncertain(spark):
    gated = C.uncertainty_gate(pairs(spark, [(.8, .2), (.9, .9)]))
    fast = selective_override(gated, F.lit(.99), "fast").orderBy("id").collect()
    assert [(r["uncertain"], r["escalated"], r["p_final"]) for r in fast] == [
        (True, False, .5), (False, False, .9)]
    up = selective_override(gated, F.lit(.99)).orderBy("id").collect()
    assert [(r["escalated"], r["p_final"]) for r in up] == [(True, .99), (False, .9)]
    with pytest.raises(ValueError):
        selective_override(gated, F.lit(1.0), "other")


def test_batch_model_sees_uncertain_rows_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(x: np.ndarray) -> np.ndarray:
        seen.add(len(x))
        return np.full(len(x), .75)

    rows = [(.8, .2)] * 30 + [(.9, .9)] * 470
    df = pairs(spark, rows).withColumns({c: F.lit(1.0) for c in S.FEATURES})
    out = selective_override(C.uncertainty_gate(df), scorer)
    got = out.groupBy("p_final").count().collect()
    assert {r["p_final"]: r["count"] for r in got} == {.75: 30, .9: 470}
    assert seen.value == 30


def test_masked_prob_with_null_mask(spark):
    df = pairs(spark, [(.1, .1), (.2, .2)]).withColumns({c: F.lit(1.0) for c in S.FEATURES})
    df = df.withColumn("m", F.when(F.col("id") == 1, True))
    got = df.select("id", masked_prob(lambda x: x[:, 10], "m").alias("p")).orderBy("id").collect()
    assert [r["p"] for r in got] == [None, .2]


def answers(spark, rows):
    return C.decision_result(spark.createDataFrame(
        rows, "http_status int, response string, error string")).collect()


def test_decision_results(spark):
    long = "x" * 300
    got = answers(spark, [
        (200, '{"decision": "anomaly", "confidence": 0.2}', None),
        (200, '{"decision": "NORMAL", "confidence": 0.9}', None),
        (200, "{}", None), (503, " a \n b ", None), (500, None, None), (500, long, None),
        (200, "{broken", None), (None, None, "TIMEOUT"), (None, None, "FAILED:no route"),
    ])
    assert [r["inference_status"] for r in got] == [
        "OK", "OK", "OK", "HTTP_503:a b", "HTTP_500", "HTTP_500:" + "x" * 220,
        "INVALID_RESPONSE:unreadable JSON", "TIMEOUT", "FAILED:no route"]
    assert [r["is_anomaly"] for r in got] == [1, 0, 0] + [None] * 6
    assert [r["p_final"] for r in got] == [.2, .9, 0.0] + [None] * 6
    assert [r["prediction"] for r in got] == ["anomaly", "NORMAL"] + ["UNKNOWN"] * 7


def test_event_priority_and_search(spark):
    df = spark.createDataFrame([
        ("r:1", 7, 1, 1, "FALLBACK_AFTER_DISAGREEMENT", "ANOMALY", "OK"),
        ("r:2", 17, 0, 1, "FALLBACK_NORMAL", "NORMAL", "OK"),
        ("r:3", 170, 0, 0, "NORMAL", "NORMAL", "OK"),
        ("r:4", 5, None, 1, "External comparison unavailable", "UNKNOWN", "TIMEOUT")],
        "event_id string, moteid int, is_anomaly int, escalated int, anomaly_reasons string,"
        " prediction string, inference_status string")
    shown = C.event_priority(df)
    rows = shown.orderBy("event_id").collect()
    assert [(r["mote"], r["priority"], r["state"]) for r in rows] == [
        ("07", "high", "Anomaly"), ("17", "review", "Escalated"), ("170", "normal", "Normal"),
        ("05", "review", "Unavailable")]
    assert rows[0]["display_type"] == "FALLBACK AFTER DISAGREEMENT"
    found = lambda q: sorted(r["event_id"] for r in C.event_search(shown, q).collect())
    assert found("mote #17") == ["r:2", "r:3"]
    assert found("Disagree") == ["r:1"]
    assert found("R:4") == ["r:4"] and len(found("")) == 4


def test_run_id_rule(spark):
    ok = ["abc-1_X", "a" * 80, "héllo"]
    bad = ["", "a b", "a" * 81, "x;y", "ab\n"]
    df = spark.createDataFrame([(x,) for x in ok + bad] + [(None,)], "r string")
    got = [r[0] for r in df.select(C.valid_run_id("r")).collect()]
    assert got == [True] * 3 + [False] * 6


def test_percent_text(spark):
    df = spark.createDataFrame([(.205,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(C.pct_format("x")).collect()] == ["20.5%", "100.0%", "0.0%"]
    text = spark.createDataFrame([("20.5%",), (" 7.0 % ",), ("0.25",), ("n/a",)], "t string")
    assert [r[0] for r in text.select(C.pct_parse("t")).collect()] == [20.5, 7.0, 25.0, None]


def test_filter_arguments(spark):
    df = spark.createDataFrame([("r", "fast", 1, 0, 0)],
                               "run_id string, system_name string, moteid int, is_anomaly int,"
                               " escalated int")
    assert C.filter_events(df, "r", "fast", 1).count() == 1
    with pytest.raises(ValueError):
        C.filter_events(df, "r", "x")
    with pytest.raises(ValueError):
        C.filter_events(df, "r", "fast", priority="x")


def test_report_text(spark):
    row = heuristic_row(spark, temperature=38.5, voltage=2.15, humidity=45.0, light=120.0,
                        delta_temp_3m=5.2, delta_volt_3m=-.45, z_temp_15m=3.8, z_volt_15m=-3.2,
                        temp_slope_15m=.15, p_if=.62, p_ae=.58)
    row = row.withColumns({"moteid": F.lit(17), "epoch": F.lit(500)})
    assert C.state_report_text(row).first()["report"] == (
        "Telemetry Report: Mote 17, Epoch 500. Temperature=38.50C (z-score=3.80,"
        " 3m-shock=+5.20C, 15m-slope=+0.150C/step). Voltage=2.15V (z-score=-3.20,"
        " 3m-shock=-0.45V). Humidity=45.0%, Light=120.0 Lux. Fast Path Prior: IF anomaly"
        " probability=0.620, AE anomaly probability=0.580.")


def test_missing_values_are_no_anomalies(spark):
    rows = [(0.4, 0.6, None, float("nan"), None, None), (0.4, 0.6, 0.0, 0.0, 0.0, 0.0),
            (None, 0.6, 0.0, 0.0, 0.0, 0.0), (float("nan"), 0.6, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "p_if double, p_ae double, z_temp_15m double,"
                               " z_volt_15m double, temp_slope_15m double, delta_temp_3m double")
    got = [tuple(r) for r in df.select(C.heuristic_prob(), C.calibrated_prob("p_if", 2.0, 0.0))
           .collect()]
    assert got[0] == got[1] and got[0][0] < 0.5
    assert got[2] == got[3] == (None, None)
