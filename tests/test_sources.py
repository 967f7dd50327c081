import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import make_readings
from sieveguard import schema as S
from sieveguard import scratch
from sieveguard.operators.windows import dual_window_features
from sieveguard.plans.study import prepare_splits
from sieveguard.sources import readings as src
from sieveguard.sources import sinks

LINE = "2004-02-28 00:59:16.02785 3 1 19.9884 37.0933 45.08 2.69964"
GOOD = {"date": "2004-02-28", "time": "00:59:16", "timestamp": "2004-02-28T00:59:16", "run_id": "r",
        "event_id": "r:1", "sent_at_epoch_ms": 5, "epoch": 3, "moteid": 1, "temperature": 19.5,
        "humidity": 37.0, "light": 45.0, "voltage": 2.6}


def messages(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values],
                                 "value string")


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{LINE}\n  {LINE}   extra words\nshort line only\n\n")
    rows = src.read_text_readings(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert rows[0]["timestamp"] == "2004-02-28T00:59:16.02785"
    assert (rows[0]["epoch"], rows[0]["moteid"], rows[0]["voltage"]) == (3, 1, 2.69964)


def test_text_with_a_bad_number(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LINE.replace("19.9884", "n/a") + "\n")
    with pytest.raises(Exception):
        src.read_text_readings(spark, str(tmp_path)).collect()
    assert src.read_text_readings(spark, str(tmp_path), strict=False).first()["temperature"] is None


def test_messages(spark):
    row = src.parse_readings(messages(spark, GOOD)).first()
    assert row.asDict() == {**{f.name: None for f in S.READING.fields}, **GOOD,
                            "ts": dt.datetime(2004, 2, 28, 0, 59, 16)}
    short = {k: v for k, v in GOOD.items() if k not in ("temperature", "epoch")}
    row = src.parse_readings(messages(spark, short)).first()
    assert row["temperature"] is None and row["epoch"] == 0


@pytest.mark.parametrize("bad", ["{broken", {**GOOD, "other": 1}, {**GOOD, "epoch": "x"}])
def test_bad_messages(spark, bad):
    with pytest.raises(Exception):
        src.parse_readings(messages(spark, bad)).collect()
    rows = src.parse_readings(messages(spark, GOOD, bad), "permissive").collect()
    assert [r["_corrupt"] is None for r in rows] == [True, False]
    assert rows[0]["voltage"] == 2.6
    with pytest.raises(ValueError):
        src.parse_readings(messages(spark, GOOD), "x")


def test_recorded_files_without_labels(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("2004-02-28", "00:59:16.0", 3, 1, 20.0, 40.0, 50.0, 2.7)],
                          "date string, time string, epoch long, moteid long, temperature double,"
                          " humidity double, light double, voltage double").write.parquet(path)
    row = src.read_parquet_readings(spark, path).first()
    assert row["timestamp"] == "2004-02-28T00:59:16.0" and row["label"] is None
    assert row["anomaly_type"] is None and row["moteid"] == 1
    assert row["ts"] == dt.datetime(2004, 2, 28, 0, 59, 16) and row["event_id"].endswith(":0")


def test_readers_fit_the_operators(spark, tmp_path):
    lines = [LINE.replace("00:59:16.02785", f"00:59:{s:02d}.5").replace(" 3 1 ", f" {s} 1 ")
             for s in range(40)]
    (tmp_path / "a.txt").write_text("\n".join([*lines, lines[0]]))
    rows = src.read_text_readings(spark, str(tmp_path))
    assert rows.count() == 41 and rows.select("event_id").distinct().count() == 40
    assert dual_window_features(rows).where("var_temp_15m is not null").count() == 41
    splits = prepare_splits(rows.withColumn("label", F.lit(0)).withColumn(
        "anomaly_type", F.lit("NORMAL")).dropDuplicates(["event_id"]))
    assert sum(part.count() for part in splits.values()) == 40
    sent = sinks.stamp_replay(rows, "x", now_ms=1)
    assert sent.select("event_id").distinct().count() == 41
    assert src.parse_readings(sent).where("ts is not null").count() == 41


def test_times_of_messages(spark):
    odd = {**GOOD, "date": "x", "timestamp": "2004-02-28T00:59:17"}
    none = {k: v for k, v in GOOD.items() if k not in ("date", "time", "timestamp")}
    got = [r["ts"] for r in src.parse_readings(messages(spark, odd, none)).collect()]
    assert got == [dt.datetime(2004, 2, 28, 0, 59, 17), None]


def test_replay_numbers_and_limit(spark):
    df = make_readings(spark, [(i % 3, 100 - i, 1.0, 2.0) for i in range(60)])
    out = sinks.stamp_replay(df, "run", ("ts", "seq"), limit=20, now_ms=9).orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, 21))
    assert out[0]["event_id"] == "run:1" and out[0]["key"] == str(59 % 3)
    assert json.loads(out[0]["value"])["run_id"] == "run"


def record(spark):
    rows = [("r", f"e{i}", ts, "2024-01-01", "10:00:00", 1, 2, 1.0, 2.0, 3.0, 4.0, None, 1, "ANOMALY",
             .5, .5, .5, True, False, "fast", "fast-path", "OK", .5, None, None, 1, 1000 + i, 3.0)
            for i, ts in enumerate(["2024-01-01T10:00:00.1234567", None, "2024-01-01T10:00:00"])]
    return spark.createDataFrame(rows, (
        "run_id string, event_id string, timestamp string, date string, time string, epoch int,"
        " moteid int, temperature double, humidity double, light double, voltage double, label int,"
        " is_anomaly int, prediction string, p_if double, p_ae double, p_final double,"
        " uncertain boolean, escalated boolean, system_name string, engine string,"
        " inference_status string, anomaly_score double, anomaly_reasons string,"
        " anomaly_type string, sent_at_epoch_ms long, processed_at_epoch_ms long,"
        " processing_latency_ms double"))


def test_event_rows(spark):
    out = sinks.event_rows(record(spark))
    assert out.columns == S.EVENT_COLUMNS
    rows = out.orderBy("event_id").collect()
    assert [r["timestamp"] for r in rows] == [
        "2024-01-01 10:00:00.123", "2024-01-01 10:00:00", "2024-01-01 10:00:00"]
    assert (rows[0]["uncertain"], rows[0]["escalated"], rows[0]["anomaly_reasons"]) == (1, 0, "")


def test_later_batch_wins(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = sinks.event_rows(record(spark))
    sinks.append_events(rows, 0, path)
    sinks.append_events(rows.withColumn("prediction", F.lit("LATER")), 1, path)
    sinks.append_events(rows, 0, path)
    current = sinks.current_events(spark, path)
    assert {r["prediction"] for r in current.collect()} == {"LATER"} and current.count() == 3


def test_alert_cap_keeps_the_newest(spark):
    out = sinks.capped_alerts(sinks.event_rows(record(spark)), cap=2).collect()
    assert sorted(r["event_id"] for r in out) == ["e1", "e2"]
    assert json.loads(out[0]["alert"])["prediction"] == "ANOMALY"


def test_run_records_keep_earlier_fields(spark):
    rows = [("r", "starting", 10, 0, 5, None, True, 1), ("r", "producer_finished", None, 10, None, 9, None, 2)]
    df = spark.createDataFrame(rows, "run_id string, status string, expected_count long,"
                               " sent_count long, started_at_epoch_ms long,"
                               " producer_finished_at_epoch_ms long, external_enabled boolean,"
                               " version int")
    row = sinks.run_registry(df).first()
    assert (row["status"], row["expected_count"], row["sent_count"], row["started_at_epoch_ms"],
            row["external_enabled"], row["version"]) == ("producer_finished", 10, 10, 5, True, 2)


def test_topics_need_the_package_or_a_checkpoint(spark):
    stream = spark.readStream.format("rate").load().select(
        F.lit("k").alias("key"), F.lit("v").alias("value"))
    with pytest.raises(ValueError):
        sinks.to_kafka(stream, "host:1", "t")


class _Session:
    """Just the settings of a session."""

    def __init__(self, settings, master, checkpoint=None):
        self.settings, self.conf, self.sparkContext = settings, self, self
        self.master, self.checkpoint = master, checkpoint

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = folder


def test_scratch_folder_follows_the_session():
    shared = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert scratch.scratch_dir(_Session(shared, "yarn")) == "hdfs://shared/x"
    assert scratch.scratch_dir(_Session({}, "yarn", "hdfs://other")) == "hdfs://other"
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(_Session({}, "yarn"))
    local = _Session({}, "local[2]")
    assert scratch.scratch_dir(local) == scratch.scratch_dir(local)


def test_written_table_keeps_rows(spark):
    assert scratch.written(spark.range(3).toDF("a"), "t").count() == 3
