import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_readings
from sieveguard import schema as S
from sieveguard.operators import windows as W

ORDER = ("ts", "seq")
DERIVED = S.FEATURES[4:]


def collect(df, names=DERIVED):
    return {r["seq"]: [r[n] for n in names] for r in df.collect()}


def same(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or x == pytest.approx(y, abs=tol), (k, a[k], b[k])


def test_thirty_rising_rows(spark):
    rows = [(1, i, 10.0 + i, 2.0 + 0.01 * i) for i in range(30)]
    last = W.dual_window_features(make_readings(spark, rows), order=ORDER).where("seq = 29").first()
    assert last["temperature"] == 39.0
    assert last["voltage"] == pytest.approx(2.29)
    assert last["delta_temp_3m"] == pytest.approx(2.5, abs=1e-9)
    assert last["delta_volt_3m"] == pytest.approx(0.025, abs=1e-9)
    assert last["temp_slope_15m"] == pytest.approx(1.0, abs=1e-9)
    assert last["var_temp_15m"] == pytest.approx(77.5, abs=1e-9)


def test_single_row(spark):
    row = W.dual_window_features(make_readings(spark, [(1, 0, 22.0, 2.7)]), order=ORDER).first()
    assert (row["z_temp_15m"], row["z_volt_15m"], row["temp_slope_15m"]) == (0.0, 0.0, 0.0)
    assert row["var_temp_15m"] == pytest.approx(0.01)


def test_flat_window_has_no_variance(spark):
    rows = [(1, i, 20.1, 2.5) for i in range(40)]
    last = W.dual_window_features(make_readings(spark, rows), order=ORDER).where("seq = 39").first()
    assert last["var_temp_15m"] == 0.0 and abs(last["z_temp_15m"]) < 1e-6


def noisy(n=900, seed=3, gaps=True):
    """Sensor 1 holds most rows; some readings are missing; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        mote = 1 if rng.random() < 0.6 else rng.randrange(2, 8)
        t = rng.gauss(20, 3)
        if gaps and rng.random() < 0.1:
            t = rng.choice([float("nan"), None])
        rows.append((mote, i // 3, t, rng.gauss(2.5, 0.1)))
    return rows


@pytest.mark.parametrize("busy", [3, 40, 200, 10_000])
def test_busy_sensors_give_equal_results(spark, busy):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = make_readings(spark, noisy()).repartition(5)
        plain = collect(W.dual_window_features(df, order=ORDER, busy_rows=None))
        same(plain, collect(W.dual_window_features(df, order=ORDER, busy_rows=busy)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_tiny_blocks(spark):
    """Blocks shorter than the window still give the plain result."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = make_readings(spark, noisy(400))
        plain = collect(W.dual_window_features(df, order=ORDER, busy_rows=None))
        same(plain, collect(W.dual_window_features(df, order=ORDER, busy_rows=10)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_input_order_does_not_matter(spark):
    df = make_readings(spark, noisy())
    same(collect(W.dual_window_features(df, order=ORDER)),
         collect(W.dual_window_features(df.orderBy(F.rand(4)).repartition(3), order=ORDER)))


def test_missing_values_are_skipped(spark):
    rows = [(1, i, None if i % 2 else float(i), 2.0) for i in range(20)]
    out = W.rolling_stats(make_readings(spark, rows), "temperature", 6, 3, order=ORDER)
    row = out.where("seq = 18").first()
    assert row["temperature_n"] == 3 and row["temperature_mean"] == pytest.approx(16.0)
    assert out.where("seq = 2").first()["temperature_mean"] is None


def test_empty_table(spark):
    df = make_readings(spark, [])
    assert W.dual_window_features(df, order=ORDER).count() == 0
    assert W.expanding_stats(df, "temperature", order=ORDER).count() == 0


def test_expanding_matches_numpy(spark):
    values = np.random.RandomState(42).normal(22.5, 3.2, 1000)
    df = make_readings(spark, [(1, i, float(x), 2.0) for i, x in enumerate(values)])
    for busy in (None, 50):
        last = W.expanding_stats(df, "temperature", order=ORDER, busy_rows=busy).where(
            "seq = 999").first()
        assert last["temperature_run_mean"] == pytest.approx(values.mean(), abs=1e-7)
        assert last["temperature_run_std"] == pytest.approx(values.std(ddof=1), abs=1e-7)


def test_expanding_z(spark):
    base = [20.0, 20.2, 19.8, 20.1, 20.0, 19.9, 20.1, 20.0, 20.2, 19.9]
    out = W.expanding_stats(make_readings(spark, [(1, i, x, 2.0) for i, x in enumerate(base)]),
                            "temperature", order=ORDER).where("seq = 9").first()
    mean, std = out["temperature_run_mean"], out["temperature_run_std"]
    assert abs(20.0 - mean) / std < 0.5 and abs(25.0 - mean) / std > 20.0
    first = W.expanding_stats(make_readings(spark, [(1, 0, 5.0, 2.0)]), "temperature",
                              order=ORDER).first()
    assert (first["temperature_run_var"], first["temperature_run_z"]) == (0.0, 0.0)


@pytest.mark.parametrize("busy", [3, 100])
def test_expanding_busy_equals_plain(spark, busy):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = make_readings(spark, [(m, s, t if t is None else t + 1e6, v)
                                   for m, s, t, v in noisy()])
        names = [f"temperature_run_{n}" for n in ("n", "mean", "var")]
        same(collect(W.expanding_stats(df, "temperature", order=ORDER, busy_rows=None), names),
             collect(W.expanding_stats(df, "temperature", order=ORDER, busy_rows=busy), names),
             tol=1e-5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_context_window_at_the_edges(spark):
    df = make_readings(spark, [(1, i, float(i), 2.0) for i in range(30)])
    df = df.withColumn("anomaly_type", F.when(F.col("seq").isin(2, 28), "DRIFT").otherwise("NORMAL"))
    first = W.context_window(df, "DRIFT", 0, 5, 5, ORDER).collect()
    assert sorted(r["seq"] for r in first) == [0, 1, 2, 3, 4, 5, 6]
    assert {r["seq"]: r["offset"] for r in first}[2] == 0
    assert sorted(r["seq"] for r in W.context_window(df, "DRIFT", 1, 3, 5, ORDER).collect()) == [
        25, 26, 27, 28, 29]
    assert W.context_window(df, "DRIFT", 2, 3, 5, ORDER).count() == 0


def test_one_shuffle_for_all_frames(spark):
    df = make_readings(spark, noisy(50))
    plan = W.dual_window_features(df, order=ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
