"""Micro-batches of the sliced events, and the files that they leave in their tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieveguard.sources.commits import CommittedTable
from sieveguard.sources.sinks import AlertList
from sieveguard.streaming import run
from workload import streams

EVENTS = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
          " props string")


@pytest.fixture
def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i // 2), i % 7, "view", float(i), '{"k": 1}')
            for i in range(320)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "sf/events.parquet"))
    return str(tmp_path / "sf")


def batches(stream, tmp_path):
    """Rows of every micro-batch."""
    seen = []
    (stream.writeStream.foreachBatch(lambda batch, _: seen.append(
        [r["seq"] for r in batch.select("seq").collect()]))
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
     .start().awaitTermination())
    return seen


@pytest.mark.parametrize("file_rows", [125_000, 15])
def test_a_slice_of_several_files_is_about_a_micro_batch(spark, events, tmp_path, monkeypatch,
                                                         file_rows):
    monkeypatch.setattr(streams, "FILE_ROWS", file_rows, raising=False)
    path = str(tmp_path / "slices")
    streams.put_slices(spark, events, path, 0, streams.SLICES)
    seen = batches(streams.sliced_stream(spark, path), tmp_path)
    assert len(seen) == streams.SLICES
    assert sorted(i for part in seen for i in part) == list(range(320))
    last = {}
    for part in seen:                                         # users' rows come in order
        for user in {i % 7 for i in part}:
            mine = [i for i in part if i % 7 == user]
            assert min(mine) > last.get(user, -1)
            last[user] = max(mine)


def test_files_of_a_slice_do_not_add_micro_batches(spark, events, tmp_path):
    path = str(tmp_path / "slices")
    rows = spark.read.parquet(f"{events}/events.parquet")
    for i in range(streams.SLICES):
        rows.where(F.col("event_id") % streams.SLICES == i).repartition(5).write.mode(
            "append").parquet(path)
    seen = batches(streams.sliced_stream(spark, path), tmp_path)
    assert [len(part) for part in seen] == [320 // streams.SLICES] * streams.SLICES


def test_slices_put_in_steps_hold_every_event_once(spark, events, tmp_path):
    path, ends = str(tmp_path / "slices"), streams.slice_ends(spark, events)
    for first, last in ((0, 4), (4, 8)):
        streams.put_slices(spark, events, path, first, last, ends)
    got = sorted(r["event_id"] for r in spark.read.parquet(path).collect())
    assert got == list(range(320))


def test_fan_out_leaves_as_many_files_as_its_rows_fill(spark, tmp_path):
    rows = spark.range(120).select(
        F.lit("r").alias("run_id"), F.col("id").cast("string").alias("event_id"),
        *[F.lit("x").alias(c) for c in ("date", "time", "timestamp", "anomaly_type", "system_name",
                                        "prediction", "anomaly_reasons", "engine",
                                        "inference_status")],
        *[F.lit(1.0).alias(c) for c in (
            "temperature", "humidity", "light", "voltage", "delta_temp_3m", "z_temp_15m",
            "temp_slope_15m", "var_temp_15m", "delta_volt_3m", "z_volt_15m", "p_if", "p_ae",
            "p_final", "anomaly_score", "processing_latency_ms")],
        *[F.lit(1).alias(c) for c in ("label", "epoch", "moteid", "is_anomaly")],
        *[F.lit(1).cast("long").alias(c) for c in ("sent_at_epoch_ms", "processed_at_epoch_ms")],
        *[F.lit(True).alias(c) for c in ("uncertain", "escalated", "disagreement")])
    run.fan_out(str(tmp_path / "out"), writer="w")(rows.repartition(12), 0)
    for name in ("events", "alerts", "uncertain"):
        table = CommittedTable(spark, f"{tmp_path}/out/{name}")
        assert table.read().count() == 120
        assert sum(p.files for p in table.state().parts) == 1


def test_an_alert_list_is_cut_once_for_each_batch(spark, tmp_path, monkeypatch):
    from sieveguard.sources import sinks
    cuts, cut = [], sinks.top_per_group
    monkeypatch.setattr(sinks, "top_per_group", lambda *a, **k: cuts.append(1) or cut(*a, **k))
    kept = AlertList(spark, str(tmp_path / "list"), cap=3)
    for number in range(3):
        rows = spark.range(10 * number, 10 * number + 10, 1, 1).select(
            F.lit("r").alias("run_id"), F.lit("e").alias("event_id"), (F.col("id") % 2 + F.lit(
                number)).alias("processed_at_epoch_ms"), F.lit(1).alias("is_anomaly"), "id")
        kept.update(rows, "s", number)
    assert len(cuts) == 3
    # Alerts of one event at one time rank by their text, in the first batch as in later ones.
    got = sorted(r["alert"] for r in kept.read().collect())
    assert [a.split('"id":')[1] for a in got] == ["25}", "27}", "29}"]
