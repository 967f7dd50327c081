import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import READING_SCHEMA, make_readings
from test_windows import ORDER, collect, noisy, same
from sieveguard.functions.columns import heuristic_prob
from sieveguard.operators.windows import dual_window_features
from sieveguard.plans.flow import both_modes, decide_records
from sieveguard.sources.commits import CommittedTable
from sieveguard.sources.sinks import current_events, read_events
from sieveguard.streaming.features import VALUES, Tails, advance, stream_features
from sieveguard.streaming.run import alert_console, run_stream, stream_dedup
from workload.base import probabilities

DRAIN = {"availableNow": True}


def source(spark, path):
    return (spark.readStream.schema(READING_SCHEMA).option("maxFilesPerTrigger", 2)
            .parquet(str(path)))


def put(df, path, low, high, files=1):
    """Append rows as files; a later call is a later arrival."""
    df.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(files).write.mode(
        "append").parquet(str(path))


def drain(df, out, state):
    (df.writeStream.format("parquet").option("path", str(out))
     .option("checkpointLocation", str(state)).trigger(**DRAIN).start().awaitTermination())


def test_stream_equals_batch_over_several_files_and_a_restart(spark, tmp_path):
    df = make_readings(spark, noisy(300))
    # micro-batches hold whole seconds, as arrival order must follow time across them
    put(df, tmp_path / "in", 0, 90, files=2)
    feats = lambda: stream_features(source(spark, tmp_path / "in"), order=ORDER)
    drain(feats(), tmp_path / "out", tmp_path / "state")
    put(df, tmp_path / "in", 90, 210, files=2)
    drain(feats(), tmp_path / "out", tmp_path / "state")
    put(df, tmp_path / "in", 210, 300, files=2)
    drain(feats(), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 300
    same(collect(dual_window_features(df, order=ORDER)), collect(got))


def test_runs_do_not_share_state(spark, tmp_path):
    a = make_readings(spark, [(1, i, float(i), 2.0) for i in range(20)])
    b = a.withColumns({"run_id": F.lit("q"), "event_id": F.concat(F.lit("q"), "event_id")})
    both = a.unionByName(b)
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(stream_features(source(spark, tmp_path / "in"), order=ORDER), tmp_path / "out",
          tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    same(collect(dual_window_features(a, order=ORDER)), collect(got.where("run_id = 'r'")))
    same(collect(dual_window_features(a, order=ORDER)), collect(got.where("run_id = 'q'")))


def labelled(df):
    return df.withColumns({
        "label": (F.col("seq") % 9 == 0).cast("int"), "anomaly_type": F.lit("NORMAL"),
        "epoch": F.col("seq").cast("int"), "date": F.lit("2024-01-01"), "time": F.lit("00:00:00"),
        "timestamp": F.lit("2024-01-01T00:00:00"), "sent_at_epoch_ms": F.lit(1000).cast("long")})


def test_fan_out_is_idempotent_and_equals_batch(spark, tmp_path):
    df = make_readings(spark, noisy(240, gaps=False))
    put(df, tmp_path / "in", 0, 240)

    def records(frame, mode="selective"):
        return decide_records(labelled(frame), probabilities, heuristic_prob(), mode,
                              F.col("sent_at_epoch_ms") + 5)

    feats = stream_features(source(spark, tmp_path / "in"), order=ORDER)
    for state in ("state-1", "state-2"):  # the second run delivers every row again
        run_stream(records(feats), str(tmp_path / "out"), str(tmp_path / state),
                   DRAIN).awaitTermination()
    events = read_events(spark, f"{tmp_path}/out/events")
    assert events.count() == 480  # two writers; neither replaces the other's rows
    again = run_stream(records(feats), str(tmp_path / "out"), str(tmp_path / "state-2"), DRAIN)
    again.awaitTermination()
    assert read_events(spark, f"{tmp_path}/out/events").count() == 480
    want = records(dual_window_features(df, order=ORDER))
    assert (events.where("is_anomaly = 1").select("event_id").distinct().count()
            == want.where("is_anomaly = 1").count()
            == CommittedTable(spark, f"{tmp_path}/out/alerts").read().select(
                "event_id").distinct().count())
    assert (want.where("uncertain").count()
            == CommittedTable(spark, f"{tmp_path}/out/uncertain").read().select(
                "event_id").distinct().count())
    current = {r["event_id"]: r["p_final"] for r in
               current_events(spark, f"{tmp_path}/out/events").collect()}
    assert current == pytest.approx({r["event_id"]: r["p_final"] for r in want.collect()})


def test_both_modes_equal_two_runs(spark):
    feats = labelled(dual_window_features(make_readings(spark, noisy(200, gaps=False)), order=ORDER))
    now = F.col("sent_at_epoch_ms") + 5
    two = both_modes(feats, probabilities, heuristic_prob(), now)
    for mode in ("fast", "selective"):
        one = decide_records(feats, probabilities, heuristic_prob(), mode, now)
        mine = two.where(F.col("system_name") == mode).select(*one.columns)
        assert mine.exceptAll(one).count() == 0 == one.exceptAll(mine).count()
    with pytest.raises(ValueError):
        decide_records(feats, probabilities, None, "external")


def test_dedup_inside_a_time_bound(spark, tmp_path):
    df = make_readings(spark, [(1, i, 1.0, 2.0) for i in range(30)])
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = source(spark, tmp_path / "in").withColumn("at", F.col("ts").cast("timestamp"))
    drain(stream_dedup(stream, "at", "1 hour", ("event_id",)), tmp_path / "out", tmp_path / "st")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_console_shows_alerts_only(spark, tmp_path):
    df = make_readings(spark, [(1, i, 1.0, 2.0) for i in range(4)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = source(spark, tmp_path / "in").select(
        "event_id", (F.col("seq") == 2).cast("int").alias("is_anomaly"))
    query = alert_console(stream, str(tmp_path / "state"), "memory", "shown")
    query.processAllAvailable()
    query.stop()
    assert [r["event_id"] for r in spark.table("shown").collect()] == ["r:2"]


def test_a_silent_sensor_starts_anew(spark, tmp_path):
    first = make_readings(spark, [(m, i, 10.0 + i, 2.0) for m in (1, 2) for i in range(12)])
    later = make_readings(spark, [(m, 100 + i, 50.0 + i, 2.0) for m in (1, 3) for i in range(2)])

    def features(expiry_ms):
        return stream_features(source(spark, tmp_path / "in"), order=ORDER, buckets=1,
                               expiry_ms=expiry_ms)

    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, expiry_ms in (("kept", 3_600_000), ("gone", 1)):
        drain(features(expiry_ms), tmp_path / name, tmp_path / f"{name}-state")
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    slopes = {}
    for name, expiry_ms in (("kept", 3_600_000), ("gone", 1)):
        drain(features(expiry_ms), tmp_path / name, tmp_path / f"{name}-state")
        rows = spark.read.parquet(str(tmp_path / name))
        assert rows.count() == 28
        slopes[name] = {r["moteid"]: r["temp_slope_15m"] for r in rows.where(
            "temperature = 50").collect()}
    assert slopes == {"kept": {1: pytest.approx(3.8), 3: 0.0}, "gone": {1: 0.0, 3: 0.0}}


def test_state_holds_the_sensors_of_the_last_while():
    fresh = {v: np.arange(40.0) for v in VALUES}
    owner = np.repeat([0, 1], 20)
    _, one = advance(Tails.empty(), ["a", "b"], owner, fresh, now=1_000)
    _, two = advance(one, ["c", "b"], owner, fresh, now=5_000)
    assert two.names == ["a", "c", "b"] and list(two.sizes) == [20, 20, 29]
    assert list(two.values["voltage"][-29:]) == list(range(31, 40)) + list(range(20, 40))
    rest = Tails.of(two.since(2_000).row())
    assert rest.names == ["c", "b"] and list(rest.seen) == [5_000, 5_000]
    assert len(rest.values["temperature"]) == 49


def test_bulk_features_equal_those_of_one_sensor_at_a_time():
    rng = np.random.default_rng(3)
    names = [f"s{i}" for i in range(30)]
    whole = {n: {v: rng.normal(20, 3, 90) for v in VALUES} for n in names}
    for n in names:
        whole[n]["temperature"][rng.random(90) < .2] = np.nan
    alone = {n: advance(Tails.empty(), [n], np.zeros(90, int), whole[n], 0)[0] for n in names}
    tails, done = Tails.empty(), dict.fromkeys(names, 0)
    for step in range(12):
        sizes = {n: int(k) for n, k in zip(names, rng.integers(0, 8, 30)) if k}
        owner = np.repeat(np.arange(len(sizes)), list(sizes.values()))
        cut = {v: np.concatenate([whole[n][v][done[n]:done[n] + k] for n, k in sizes.items()])
               for v in VALUES}
        got, tails = advance(tails, list(sizes), owner, cut, step)
        at = 0
        for n, k in sizes.items():
            for c in got:
                np.testing.assert_allclose(got[c][at:at + k], alone[n][c][done[n]:done[n] + k])
            at, done[n] = at + k, done[n] + k
