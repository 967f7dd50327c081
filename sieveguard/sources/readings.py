"""Readers of sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard import schema as S

CORRUPT = "_corrupt"
# Rows of a topic and files of a folder that one micro-batch takes by default.
BATCH_OFFSETS, BATCH_FILES = 1_000_000, 64


def parse_readings(messages: DataFrame, mode: str = "failfast", value: str = "value") -> DataFrame:
    """JSON messages to readings (batch or stream), with their time in ``ts``.

    ``failfast`` stops on malformed JSON and on unknown fields; ``permissive`` keeps the
    row, with the raw message in ``_corrupt``.
    """
    text = F.col(value).cast("string")
    if mode == "permissive":
        layout = T.StructType([*S.READING.fields, T.StructField(CORRUPT, T.StringType())])
        parsed = F.from_json(text, layout, {"mode": "PERMISSIVE",
                                            "columnNameOfCorruptRecord": CORRUPT})
        return _quarantine_unknown(messages, text, parsed)
    if mode != "failfast":
        raise ValueError("mode must be failfast or permissive")
    parsed = F.from_json(text, S.READING, {"mode": "FAILFAST"})
    unknown = _unknown_fields(text)
    guard = F.when(F.size(unknown) > 0, F.raise_error(
        F.concat(F.lit("unknown reading fields: "), F.array_join(unknown, ", "))))
    checked = messages.select(F.coalesce(guard.cast(S.READING), parsed).alias("r"))
    return _with_zero_defaults(checked.select("r.*"))


def _unknown_fields(text: Column) -> Column:
    known = F.array(*[F.lit(f.name) for f in S.READING.fields])
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")),
                          known)


def _quarantine_unknown(messages: DataFrame, text: Column, parsed: Column) -> DataFrame:
    rows = messages.select(text.alias("_text"), parsed.alias("r"), _unknown_fields(text).alias("u"))
    bad = F.coalesce(F.col(f"r.{CORRUPT}"),
                     F.when((F.size("u") > 0) | F.col("r").isNull(), F.col("_text")))
    return _with_zero_defaults(
        rows.select(*[F.col(f"r.{f.name}").alias(f.name) for f in S.READING.fields],
                    bad.alias(CORRUPT)))


def _with_zero_defaults(df: DataFrame) -> DataFrame:
    """Absent numbers of a message: identifiers become 0, readings stay missing."""
    return with_time(df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                                     for c in ("epoch", "moteid", "sent_at_epoch_ms")}))


def with_time(df: DataFrame) -> DataFrame:
    """Adds ``ts`` from date and time, else from the timestamp text; null if neither is a time."""
    def time(text: Column) -> Column:
        return text.try_cast("timestamp_ntz")
    return df.withColumn("ts", F.coalesce(
        time(F.concat("date", F.lit(" "), "time")), time(F.col("timestamp"))))


def read_sensor_stream(spark: SparkSession, bootstrap: str, topic: str, mode: str = "failfast",
                       **options: str) -> DataFrame:
    """Readings of a topic from its first offset (needs Spark's Kafka package).

    A micro-batch takes BATCH_OFFSETS messages unless ``maxOffsetsPerTrigger`` says otherwise, so
    that a backlog is worked off in bounded steps.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", topic).option("startingOffsets", "earliest")
              .option("maxOffsetsPerTrigger", BATCH_OFFSETS))
    return parse_readings(reader.options(**options).load(), mode)


def read_json(spark: SparkSession, path: str, streaming: bool = False,
              mode: str = "FAILFAST", **options) -> DataFrame:
    """Readings from JSON files with their time in ``ts``; BATCH_FILES files a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", BATCH_FILES) if streaming else spark.read
    return with_time(reader.schema(S.READING).option("mode", mode).options(**options).json(path))


def _stamp(df: DataFrame) -> DataFrame:
    return with_time(df.withColumn("timestamp", F.concat("date", F.lit("T"), "time")))


def read_parquet_readings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded readings; label and type are optional in the files.

    Adds ``ts`` and an ``event_id`` (file and row in it) where the files have none.
    """
    df = spark.read.parquet(path)
    present = {c: F.col(c) for c in df.columns}
    columns = []
    for c in ("date", "time", "epoch", "moteid", "temperature", "humidity", "light", "voltage",
              "label", "anomaly_type"):
        kind = S.READING[c].dataType
        columns.append(present.get(c, F.lit(None)).cast(kind).alias(c))
    place = F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string"))
    columns.append(present.get("event_id", place).cast("string").alias("event_id"))
    return _stamp(df.select(*columns))


def read_text_readings(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Whitespace-separated log: date time epoch mote temperature humidity light voltage.

    Lines with fewer than eight words are skipped, further words ignored.  A word that
    is no number stops the job, or becomes null with ``strict=False``.

    Adds ``ts`` and an ``event_id`` of mote, epoch and a hash of the eight words: the same on
    every read. A reading that occurs twice has one id, as a message that is delivered twice;
    ``sinks.stamp_replay`` numbers every line.
    """
    words = spark.read.text(path).select(F.split(F.trim(
        F.regexp_replace("value", r"\s+", " ")), " ").alias("w")).where(F.size("w") >= 8)
    def number(i: int, kind: str) -> Column:
        return F.col("w")[i].cast(kind) if strict else F.col("w")[i].try_cast(kind)
    return _stamp(words.select(
        F.col("w")[0].alias("date"), F.col("w")[1].alias("time"),
        number(2, "int").alias("epoch"), number(3, "int").alias("moteid"),
        *[number(i, "double").alias(c) for i, c in
          enumerate(("temperature", "humidity", "light", "voltage"), start=4)],
        F.concat_ws(":", F.col("w")[3], F.col("w")[2], F.lower(F.hex(F.xxhash64(
            F.slice("w", 1, 8))))).alias("event_id")))
