import pytest
from pyspark.sql import functions as F

from conftest import make_readings
from sieveguard.operators import prepare as P

ORDER = ("ts", "seq")
M = 2_147_483_647


def base(spark, n=6000, motes=7):
    return make_readings(spark, [(i % motes if i % 3 else 0, i, 20.0 + (i * 37 % 101) / 10, 2.5)
                                 for i in range(n)])


def mixed(pos, seed, stream):
    h = (pos * 7919 + seed * 104729 + stream * 15485863) % M * 48271 % M
    return h * h % M


def uni(pos, seed, stream):
    return mixed(pos, seed, stream) / M


def plan(n, share, length, seed, stream, first, tail, short, long, salt=0):
    if n - tail - first <= 0:
        return []
    out = []
    for b in range(int(n * share / length)):
        x = b + salt
        out.append((first + int(uni(x, seed, stream) * (n - tail - first)),
                    short + int(uni(x, seed, stream + 1) * (long - short)),
                    .2 + .3 * uni(x, seed, stream + 2)))
    return out


def drift_blocks(n, rate, seed, salt=0):
    return plan(n, rate, 40, seed, 10, 100, 60, 25, 45, salt)


def flat_blocks(n, rate, seed, salt=0):
    return plan(n, rate, 25, seed, 20, 100, 40, 15, 30, salt)


def edit(temps, volts, drift, flat):
    """The block edits one after another, as a loop."""
    kinds = [None] * len(temps)
    for start, length, slope in drift:
        for step in range(length):
            temps[start + step] += step * slope
            kinds[start + step] = "DRIFT"
    for start, length, _ in flat:
        t, v = temps[start], volts[start]
        for at in range(start, start + length):
            temps[at], volts[at], kinds[at] = t, v, "FLATLINE"
    return kinds


@pytest.mark.parametrize("rate", [0.008, 0.5, 2.0])
def test_flatline_chains_match_a_loop(spark, rate):
    df = base(spark)
    rows = df.orderBy("seq").collect()
    temps, volts = [r["temperature"] for r in rows], [r["voltage"] + r["seq"] / 1e4 for r in rows]
    kinds = edit(temps, volts, [], flat_blocks(len(rows), rate, 7))
    df = df.withColumn("voltage", F.col("voltage") + F.col("seq") / 1e4)
    got = P.inject_flatline(df, rate, 7, order=ORDER).orderBy("seq").collect()
    assert [r["temperature"] for r in got] == temps
    assert [r["voltage"] for r in got] == pytest.approx(volts)
    assert [r["flat_type"] for r in got] == kinds


def test_drifts_add_up(spark):
    df = base(spark)
    temps = [r["temperature"] for r in df.orderBy("seq").collect()]
    edit(temps, temps[:], drift_blocks(len(temps), 0.8, 3), [])
    got = P.inject_drift(df, 0.8, 3, order=ORDER).orderBy("seq").collect()
    assert [r["temperature"] for r in got] == pytest.approx(temps)


def test_all_edits_in_sequence(spark):
    df = base(spark)
    n = df.count()
    rows = df.orderBy("seq").collect()
    temps, volts = [r["temperature"] for r in rows], [r["voltage"] for r in rows]
    picked = sorted(range(n), key=lambda p: (mixed(p, 42, 0), p))[:int(n * .012)]
    spikes = {}
    for p in picked:
        if uni(p, 42, 1) > .5:
            temps[p] += (8 + 12 * uni(p, 42, 2)) * (1 if uni(p, 42, 3) > .3 else -1)
            spikes[p] = "SPIKE_TEMP"
        else:
            volts[p] = max(1.8, volts[p] - (.4 + .5 * uni(p, 42, 4)))
            spikes[p] = "SPIKE_VOLT_DROP"
    kinds = edit(temps, volts, drift_blocks(n, .01, 42), flat_blocks(n, .008, 42))
    kinds = [k or spikes.get(i, "NORMAL") for i, k in enumerate(kinds)]
    got = P.inject_anomalies(df, order=ORDER).orderBy("seq").collect()
    assert [r["temperature"] for r in got] == pytest.approx(temps)
    assert [r["voltage"] for r in got] == pytest.approx(volts)
    assert [r["anomaly_type"] for r in got] == kinds
    assert sum(r["label"] for r in got) == sum(k != "NORMAL" for k in kinds)


def test_edits_per_sensor(spark):
    df = base(spark, 4000, 3)
    salts = {r["moteid"]: r["s"] for r in df.select("moteid").distinct().select(
        "moteid", (F.pmod(F.xxhash64("moteid"), F.lit(1_000_003)) * 1009).alias("s")).collect()}
    got = P.inject_flatline(df, .5, 7, "sensor", ORDER).orderBy("seq").collect()
    for mote, salt in salts.items():
        mine = [r for r in df.orderBy("seq").collect() if r["moteid"] == mote]
        temps = [r["temperature"] for r in mine]
        edit(temps, [0.0] * len(temps), [], flat_blocks(len(mine), .5, 7, salt))
        assert [r["temperature"] for r in got if r["moteid"] == mote] == temps


def test_same_seed_same_edits_on_any_partitioning(spark):
    df = base(spark)
    one = P.inject_anomalies(df.repartition(1), 5, order=ORDER).orderBy("seq").collect()
    many = P.inject_anomalies(df.repartition(9), 5, order=ORDER).orderBy("seq").collect()
    other = P.inject_anomalies(df, 6, order=ORDER).orderBy("seq").collect()
    assert [r["temperature"] for r in one] == [r["temperature"] for r in many]
    assert [r["temperature"] for r in one] != [r["temperature"] for r in other]


def test_large_plans_join_without_broadcast(spark, monkeypatch):
    df = base(spark)
    small = P.inject_anomalies(df, order=ORDER).orderBy("seq").collect()
    monkeypatch.setattr(P, "PLAN_BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(P, "PLAN_CHUNK", 2)
    assert [r["temperature"] for r in P.inject_anomalies(df, order=ORDER).orderBy("seq").collect()
            ] == [r["temperature"] for r in small]


def test_short_tables_have_no_blocks(spark):
    df = base(spark, 50)
    out = P.inject_anomalies(df, order=ORDER)
    assert out.count() == 50 and out.where("anomaly_type in ('DRIFT', 'FLATLINE')").count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 10, 997])
def test_split_sizes(spark, n):
    df = P.chronological_split(base(spark, n), order=ORDER)
    got = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    a, b = int(n * .6), int(n * (.6 + .2))
    want = {k: v for k, v in (("train", a), ("val", b - a), ("test", n - b)) if v}
    assert got == want


def test_audits(spark):
    rows = [("train", 1, 0, "NORMAL"), ("train", 5, 0, "NORMAL"), ("val", 5, 1, "DRIFT"),
            ("val", 9, 0, "NORMAL"), ("test", 8, 0, "NORMAL")]
    df = spark.createDataFrame(rows, "split string, ts int, label int, anomaly_type string")
    got = {(r["earlier"], r["later"]): r["passed"] for r in P.leakage_audit(df).collect()}
    assert got == {("train", "val"): True, ("val", "test"): False}
    assert P.clean_train_check(df).first()["passed"]
    dirty = df.withColumn("label", F.lit(1))
    assert not P.clean_train_check(dirty).first()["passed"]
    assert {r["split"]: r["passed"] for r in P.prevalence_check(df).collect()} == {
        "val": False, "test": False}
