"""Row layouts and fixed names shared by batch and streaming code."""

from __future__ import annotations

from pyspark.sql import types as T

# The feature order is a contract between features, models and
# calibration files.
FEATURES = [
    "temperature", "humidity", "light", "voltage",
    "delta_temp_3m", "delta_volt_3m",
    "z_temp_15m", "z_volt_15m",
    "temp_slope_15m", "var_temp_15m",
]

# Row counts of the two windows, the slope lag, the least number of
# values for a long window, and the spreads assumed before that number is reached.
SHORT_ROWS = 6
LONG_ROWS = 30
SLOPE_LAG = 10
MIN_LONG_VALUES = 3
WARMUP_TEMP_STD = 0.1
WARMUP_VOLT_STD = 0.01
STD_EPSILON = 1e-4

# Gate margins, decision threshold, clip range of the sigmoids.
MARGIN_LOW = 0.35
MARGIN_HIGH = 0.65
THRESHOLD = 0.5
CLIP = 25.0

# Labels written into decision rows.
MODE_FAST = "fast"
MODE_SELECTIVE = "selective"
MODE_EXTERNAL = "external"
MODES = (MODE_FAST, MODE_SELECTIVE, MODE_EXTERNAL)
ENGINE_FAST = "fast-path"
ENGINE_FALLBACK = "fallback"
ENGINE_EXTERNAL = "external"

# Anomaly types by family.
FAMILIES = {
    "spikes": ("SPIKE_TEMP", "SPIKE_VOLT_DROP"),
    "drift": ("DRIFT",),
    "flatline": ("FLATLINE",),
}

READING = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("sent_at_epoch_ms", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("moteid", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("light", T.DoubleType()),
    T.StructField("voltage", T.DoubleType()),
])

# Columns of the decision table, in order, and its row identity.
EVENT_COLUMNS = [
    "run_id", "event_id", "timestamp", "date", "epoch", "moteid",
    "temperature", "humidity", "light", "voltage", "ground_truth", "is_anomaly",
    "prediction", "p_if", "p_ae", "p_final", "uncertain", "escalated",
    "system_name", "engine", "inference_status", "anomaly_score",
    "anomaly_reasons", "anomaly_type", "sent_at_epoch_ms",
    "processed_at_epoch_ms", "processing_latency_ms",
]
EVENT_KEY = ("run_id", "event_id", "engine")

# Fields of a request to an external decision model, in order.
REQUEST_FIELDS = ["moteid", "epoch", *FEATURES, "p_if", "p_ae"]

# Columns of the recent-events list.
RECENT_COLUMNS = [
    "run_id", "event_id", "timestamp", "moteid", "epoch", "temperature", "humidity",
    "light", "voltage", "ground_truth", "prediction", "is_anomaly", "p_if", "p_ae",
    "p_final", "escalated", "engine", "inference_status", "anomaly_reasons",
    "processing_latency_ms",
]
