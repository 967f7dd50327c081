import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveguard.operators import aggregates as A
from sieveguard.operators import ranking as R
from sieveguard.operators import topk
from sieveguard.operators.dedup import latest_by_key, top_per_group
from sieveguard.plans import evaluation as E

EVENT = ("run_id string, system_name string, event_id string, ground_truth int, is_anomaly int,"
         " uncertain int, escalated int, processed_at_epoch_ms long, processing_latency_ms double")


def events(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        up = int(rng.random() < .3)
        guess = rng.choice([0, 1, None]) if up else rng.randrange(2)
        rows.append(("r", "selective" if i % 2 else "fast", f"e{i}", rng.choice([0, 1, None]),
                     guess, up, up, 1000 + i * 700, float(rng.randrange(900))))
    return spark.createDataFrame(rows, EVENT), rows


def test_summary_ignores_unknown_decisions(spark):
    df, rows = events(spark)
    got = {r["system_name"]: r for r in A.run_summary(df).collect()}
    for system in ("fast", "selective"):
        mine = [r for r in rows if r[1] == system]
        cell = lambda t, g: sum(1 for r in mine if r[3] == t and r[4] == g)
        row = got[system]
        assert row["total"] == len(mine)
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (
            cell(1, 1), cell(0, 1), cell(1, 0), cell(0, 0))


def test_metric_conventions(spark):
    df = spark.createDataFrame([(0, 0, 5, 5)], "tp int, fp int, fn int, tn int")
    row = A.detection_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["fpr"]) == (None, 0.0, None, 0.0)
    row = A.detection_metrics(df, zero_division=0.0).first()
    assert (row["precision"], row["f1"]) == (0.0, 0.0)


def test_empty_summary(spark):
    df = spark.createDataFrame([], EVENT)
    assert A.run_summary(df).count() == 0
    row = A.confusion_matrix(df).first()
    assert (row["tp"], row["tn"]) == (0, 0)
    assert R.roc_auc(df, score="processing_latency_ms", label="ground_truth").first()[0] is None


def test_throughput_of_one_row(spark):
    df = spark.createDataFrame([(1, 5, 5), (10, 1000, 3000)], "total long, first_ms long, last_ms long")
    assert [r["throughput_eps"] for r in A.throughput(df).collect()] == [0.0, 5.0]


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_exact_quantiles_match_numpy(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(40)) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), (None, 3.0)],
                               "g string, x double")
    out = A.exact_quantiles(df, "x", {"p50": .5, "p95": .95, "p99": .99}, ["g"])
    got = {r["g"]: r for r in out.collect()}
    for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert got["a"][name] == pytest.approx(np.percentile(values, q))
    assert got[None]["p50"] == 3.0


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    wins = sum((a > b) + .5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(scores, labels):
    total, out, last = sum(labels), 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        hit = [y for s, y in zip(scores, labels) if s >= t]
        recall = sum(hit) / total
        out, last = out + (recall - last) * sum(hit) / len(hit), recall
    return out


@pytest.mark.parametrize("seed,levels", [(1, 5), (2, 1000), (3, 2)])
def test_ranking_areas_match_brute_force(spark, seed, levels):
    rng = random.Random(seed)
    rows = [(("x", "y")[i % 2], rng.randrange(levels) / levels, int(rng.random() < .3))
            for i in range(240)]
    df = spark.createDataFrame(rows, "g string, p_final double, label int").repartition(6)
    for r in R.ranking_metrics(df, ["g"]).collect():
        s, y = zip(*[(a, b) for g, a, b in rows if g == r["g"]])
        assert r["roc_auc"] == pytest.approx(brute_auc(s, y))
        assert r["pr_auc"] == pytest.approx(brute_ap(s, y))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(.3, 1), (.4, 1)], "p_final double, label int")
    row = R.ranking_metrics(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 1.0


def scored(spark, n=500, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([.2, .5, rng.random()])
        b = a if rng.random() < .4 else rng.random()
        rows.append((i, a, b, rng.random(), int(rng.random() < .2),
                     rng.choice(["DRIFT", "FLATLINE", "SPIKE_TEMP", "NORMAL"])))
    return spark.createDataFrame(
        rows, "seq int, p_if double, p_ae double, p_fallback double, label int,"
              " anomaly_type string"), rows


def uncertainty(a, b):
    return 1.5 * abs(a - b) + (1 - 2 * abs(a - .5)) + (1 - 2 * abs(b - .5))


def test_sweep_matches_brute_force(spark):
    df, rows = scored(spark)
    ranked = sorted(rows, key=lambda r: (-uncertainty(r[1], r[2]), r[0]))
    got = {r["rate"]: r for r in E.escalation_sweep(df, unique="seq").collect()}
    assert sorted(got) == list(topk.SWEEP_RATES)
    for rate, row in got.items():
        k = round(rate * len(rows))
        assert row["escalated"] == k
        up = {r[0] for r in ranked[:k]}
        p = [r[3] if r[0] in up else .5 * (r[1] + r[2]) for r in rows]
        y = [r[4] for r in rows]
        tp = sum(1 for s, t in zip(p, y) if s >= .5 and t)
        assert row["recall"] == pytest.approx(tp / sum(y))
        assert row["precision"] == pytest.approx(tp / sum(s >= .5 for s in p))
        assert row["pr_auc"] == pytest.approx(brute_ap(p, y))


def test_half_even_counts(spark):
    df, rows = scored(spark, 10)
    got = topk.escalation_topk(df, (.05, .15, .25), "seq").groupBy("rate").count().collect()
    assert {r["rate"]: r["count"] for r in got} == {.15: 2, .25: 2}


def test_evaluate_systems(spark):
    df, rows = scored(spark)
    df = df.withColumn("uncertain", F.abs(F.col("p_if") - F.col("p_ae")) > .2)
    got = {r["system"]: r for r in
           E.evaluate_systems(df, E.system_scores(df, "p_fallback")).collect()}
    assert sorted(got) == ["A", "B", "C", "D"]
    p = [r[3] if abs(r[1] - r[2]) > .2 else .5 * (r[1] + r[2]) for r in rows]
    y = [r[4] for r in rows]
    assert got["D"]["roc_auc"] == pytest.approx(brute_auc(p, y))
    drift = [(s, t) for s, t, r in zip(p, y, rows) if r[5] == "DRIFT" and t]
    assert got["D"]["drift_recall"] == pytest.approx(sum(s >= .5 for s, _ in drift) / len(drift))
    assert got["A"]["escalation_pct"] == 0.0 < got["D"]["escalation_pct"]
    text = E.result_table(spark.createDataFrame([got["D"]])).first()
    assert text["drift_recall"].endswith("%")


def test_capacity(spark):
    df = spark.createDataFrame([(0.0, 84.70959999976913, 5.78), (1.0, 84.7096, 5.7806), (0.0, 1.0, 1.0),
                                (0.0, 0.0, 0.0)], "rate double, fast_us double, fallback_us double")
    got = [r["estimated_capacity"] for r in E.capacity_estimate(df).collect()]
    assert got[0] == pytest.approx(11805.037, abs=.01)
    assert got[1] == pytest.approx(11050.9, abs=.1)
    assert got[2:] == [35000.0, 0.0]


def test_running_quality_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(2), rng.randrange(2), rng.randrange(2), float(rng.randrange(50)))
            for i in range(1003)]
    df = spark.createDataFrame(rows, "seq int, label int, is_anomaly int, escalated int,"
                                     " processing_latency_ms double").repartition(5)
    got = {r["processed"]: r for r in R.running_quality(
        df, 250, order=("seq",), exact=True).collect()}
    assert sorted(got) == [250, 500, 750, 1000, 1003]
    for n, row in got.items():
        part = rows[:n]
        tp = sum(1 for r in part if r[1] and r[2])
        assert row["precision"] == pytest.approx(tp / sum(r[2] for r in part))
        assert row["escalated_pct"] == pytest.approx(100 * sum(r[3] for r in part) / n)
        assert row["p95"] == pytest.approx(np.percentile([r[4] for r in part], 95))


def test_sketched_running_quality_keeps_its_rank_error(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, i % 3 == 0, 0, None if i < 40 or i % 50 == 0 else rng.gauss(100, 20))
            for i in range(2_000)]
    df = spark.createDataFrame(rows, "seq int, label int, is_anomaly boolean, escalated int,"
                                     " processing_latency_ms double").withColumn(
        "is_anomaly", F.col("is_anomaly").cast("int")).repartition(5)
    got = {r["processed"]: r for r in R.running_quality(df, 20, order=("seq",)).collect()}
    assert len(got) == 100 and got[20]["p50"] is None and got[40]["p95"] is None
    exact = {r["processed"]: r for r in R.running_quality(
        df, 20, order=("seq",), exact=True).collect()}
    for n, row in got.items():
        values = np.array([r[4] for r in rows[:n] if r[4] is not None])
        for name, q in (("p50", .5), ("p95", .95)) if len(values) else ():
            rank = (values <= row[name]).mean()
            assert abs(rank - q) <= R.SKETCH_ERROR + 1 / len(values)
        assert row["f1"] == exact[n]["f1"]
    assert R.running_quality(df.limit(0), 20, order=("seq",)).count() == 0


def test_series_span_ends_at_last_row_of_the_run(spark):
    ms = 1_700_000_000_000
    rows = [("r", "fast", "a", 0, 0, 0, 0, ms, 1.0), ("r", "fast", "b", 0, 1, 0, 1, ms + 61_000, 1.0),
            ("r", "selective", "c", 0, 0, 0, 0, ms + 3_600_500, 1.0),
            ("q", "fast", "d", 0, 0, 0, 0, ms + 9_000_000, 1.0)]
    out = A.event_series(spark.createDataFrame(rows, EVENT), "r", "fast", "1h").collect()
    assert [(r["readings"], r["anomalies"], r["escalated"]) for r in out] == [(1, 1, 1)]
    assert out[0]["bucket_ms"] % 60_000 == 0


def test_idle_status(spark):
    summary = A.run_summary(events(spark)[0])
    runs = spark.createDataFrame([("r", "producer_finished", 200, None), ("new", "starting", 9, None)],
                                 "run_id string, status string, expected_count long,"
                                 " external_enabled boolean")
    status = A.run_status(summary, runs)
    assert {r["status"] for r in status.where("total > 0").collect()} == {"complete"}
    empty = status.where("total = 0").collect()
    assert [(r["run_id"], r["status"], r["uncertain"], r["expected"]) for r in empty] == \
        [("new", "running", 0, 9)] * 2
    idle = A.with_idle(status, None, "fast").first()
    assert (idle["status"], idle["total"], idle["uncertain"]) == ("idle", 0, 0)
    assert A.with_idle(status, "r", "fast").count() == 1


def test_latest_by_key_limits_before_the_shuffle(spark):
    df, _ = events(spark)
    out = latest_by_key(df.withColumn("engine", F.lit("x")), ("run_id", "engine"))
    assert [r["event_id"] for r in out.collect()] == ["e399"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_per_group(spark):
    df = spark.range(5000).select((F.col("id") % 2 * 0).alias("g"), "id", (F.col("id") % 97).alias("v"))
    got = top_per_group(df, ["g"], ["-v", "id"], 120, unique="id").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 97), i))[:120]
    assert sorted(r["id"] for r in got) == sorted(want)


def test_parity(spark):
    s = "event_id string, p_if double, p_ae double, p_final double, escalated boolean"
    a = spark.createDataFrame([("1", .1, .1, .1, True), ("2", .1, .1, .1, True),
                               ("3", .1, .1, None, True), ("4", .1, .1, .1, True)], s)
    b = spark.createDataFrame([("1", .1, .1 + 9e-6, .1, True), ("2", .1, .1 + 2e-5, .1, True),
                               ("3", .1, .1, .1, True), ("5", .1, .1, .1, True)], s)
    got = {r["event_id"]: r["problem"] for r in E.parity_check(a, b).collect()}
    assert got == {"2": "score", "3": "score", "4": "missing", "5": "missing"}
