"""Row-window features over a stream, with at most the last 29 readings of a sensor as state.

Sensors are dealt into buckets by a hash, and a bucket is one group of the stateful operator: all
its rows of a micro-batch are computed in one pass over flat arrays, and its state is one row of
packed arrays. The cost of a micro-batch then follows its rows, not its number of sensors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveguard import schema as S
from sieveguard.functions.columns import default_identity
from sieveguard.operators.ordering import split_order

KEPT_ROWS = S.LONG_ROWS - 1
DERIVED = S.FEATURES[4:]
VALUES = ("temperature", "voltage")
BUCKETS = 64                      # of sensors; fixed for the life of a checkpoint
EXPIRY_MS = 30 * 24 * 3_600_000   # a sensor silent for so long starts anew
ROWS_AT_ONCE = 1 << 17            # windows laid out at a time
STATE = T.StructType([
    T.StructField("names", T.StringType()), T.StructField("seen", T.BinaryType()),
    T.StructField("sizes", T.BinaryType()),
    *[T.StructField(v, T.BinaryType()) for v in VALUES]])


@dataclass
class Tails:
    """The last readings of a bucket's sensors: ``values`` are flat, ``sizes`` rows a sensor."""

    names: list[str]
    seen: np.ndarray
    sizes: np.ndarray
    values: dict[str, np.ndarray]

    @classmethod
    def empty(cls) -> Tails:
        return cls([], np.zeros(0, np.int64), np.zeros(0, np.int64),
                   {v: np.zeros(0) for v in VALUES})

    @classmethod
    def of(cls, row: tuple) -> Tails:
        names, seen, sizes, *values = row
        return cls(json.loads(names), np.frombuffer(seen, np.int64), np.frombuffer(sizes, np.int64),
                   {v: np.frombuffer(x, np.float64) for v, x in zip(VALUES, values)})

    def row(self) -> tuple:
        return (json.dumps(self.names), self.seen.tobytes(), self.sizes.tobytes(),
                *[self.values[v].tobytes() for v in VALUES])

    def since(self, oldest: int) -> Tails:
        """Without the sensors last seen before ``oldest``."""
        keep = self.seen >= oldest
        if keep.all():
            return self
        rows = np.repeat(keep, self.sizes)
        return Tails([n for n, k in zip(self.names, keep) if k], self.seen[keep], self.sizes[keep],
                     {v: x[rows] for v, x in self.values.items()})


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _mean(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (~np.isnan(frames)).sum(axis=1)
    total = np.nansum(frames, axis=1)
    return n, np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)


def _spread(frames: np.ndarray, n: np.ndarray, mean: np.ndarray, fill: float) -> np.ndarray:
    gap = frames - mean[:, None]
    square = np.nansum(gap * gap, axis=1)
    std = np.sqrt(np.divide(square, n - 1, out=np.zeros(len(n)), where=n > 1))
    return np.where(n >= S.MIN_LONG_VALUES, std, fill)


def features_at(lines: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """Derived features of the readings at places ``at`` of the flat ``lines``.

    Every sensor's values stand together, after LONG_ROWS places of NaN.
    """
    out: dict[str, np.ndarray] = {}
    stats = {}
    for name, short, fill in (("temperature", "temp", S.WARMUP_TEMP_STD),
                              ("voltage", "volt", S.WARMUP_VOLT_STD)):
        line, x = lines[name], lines[name][at]
        near = np.lib.stride_tricks.sliding_window_view(line, S.SHORT_ROWS)
        _, short_mean = _mean(near[at - S.SHORT_ROWS + 1])
        far = np.lib.stride_tricks.sliding_window_view(line, S.LONG_ROWS)[at - S.LONG_ROWS + 1]
        n, mean = _mean(far)
        std = _spread(far, n, mean, fill)
        z = (x - mean) / (std + S.STD_EPSILON)
        out[f"delta_{short}_3m"] = x - short_mean
        out[f"z_{short}_15m"] = np.where((n >= S.MIN_LONG_VALUES) & ~np.isnan(z), z, 0.0)
        stats[short] = std
    temp = lines["temperature"]
    slope = (temp[at] - temp[at - S.SLOPE_LAG]) / S.SLOPE_LAG
    out["temp_slope_15m"] = np.where(np.isnan(slope), 0.0, slope)
    out["var_temp_15m"] = stats["temp"] ** 2
    return out


def advance(tails: Tails, names: list[str], owner: np.ndarray, fresh: dict[str, np.ndarray],
            now: int) -> tuple[dict[str, np.ndarray], Tails]:
    """Features of new readings of one bucket, and its state after them.

    ``owner`` numbers the sensor of each reading in ``names``; a sensor's readings stand together
    and in order.
    """
    place = {n: i for i, n in enumerate(tails.names)}
    known = np.array([place.get(n, -1) for n in names], np.int64)
    first = np.cumsum(tails.sizes) - tails.sizes
    old_size = np.where(known >= 0, np.append(tails.sizes, 0)[known], 0)
    old_from = np.where(known >= 0, np.append(first, 0)[known], 0)
    new_size = np.bincount(owner, minlength=len(names))
    block = S.LONG_ROWS + old_size + new_size
    start = np.cumsum(block) - block + S.LONG_ROWS
    at = _spans(start + old_size, new_size)
    lines = {}
    for v in VALUES:
        line = np.full(int(block.sum()), np.nan)
        line[_spans(start, old_size)] = tails.values[v][_spans(old_from, old_size)]
        line[at] = fresh[v]
        lines[v] = line
    parts = [features_at(lines, at[i:i + ROWS_AT_ONCE]) for i in range(0, len(at), ROWS_AT_ONCE)]
    derived = {n: np.concatenate([p[n] for p in parts]) for n in DERIVED}

    size = np.minimum(old_size + new_size, KEPT_ROWS)
    last = _spans(start + old_size + new_size - size, size)
    rest = np.ones(len(tails.names), bool)
    rest[known[known >= 0]] = False
    rows = np.repeat(rest, tails.sizes)
    after = Tails([*[n for n, k in zip(tails.names, rest) if k], *names],
                  np.append(tails.seen[rest], np.full(len(names), now, np.int64)),
                  np.append(tails.sizes[rest], size),
                  {v: np.append(tails.values[v][rows], lines[v][last]) for v in VALUES})
    return derived, after


def stream_features(readings: DataFrame, key: Sequence[str] = ("run_id", "moteid"),
                    order: Sequence[str] = ("ts", "event_id"), buckets: int = BUCKETS,
                    expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Adds the derived features to a stream of readings, one output row per input row.

    Rows of a micro-batch are put in order per key before use; rows that arrive in a
    later micro-batch count as later, as in any arrival-order stream.  One bucket's rows
    of a micro-batch meet in one task, so bound the trigger (files or offsets per
    trigger) when a sensor is very busy, and choose more ``buckets`` for more tasks.

    Readings of a sensor that has been silent for ``expiry_ms`` of processing time are never used
    again: a later reading starts a new window. They leave the state with the next rows of their
    bucket, whichever sensor sends them. (A timer would keep a stream with the ``availableNow``
    trigger from ending, as Spark then runs batches without data for ever.)
    """
    if {"run_id", "event_id", "moteid", "epoch", "sent_at_epoch_ms"} <= set(readings.columns):
        # A missing run is named before it becomes part of the state's key.
        readings = default_identity(readings, F.unix_millis(F.current_timestamp()))
    columns = readings.columns
    names = [split_order(o)[0] for o in order]
    ascending = [not split_order(o)[1] for o in order]
    schema = T.StructType([f for f in readings.schema.fields if f.name not in DERIVED]
                          + [T.StructField(c, T.DoubleType()) for c in DERIVED])
    base = [c for c in columns if c not in DERIVED]
    keys = list(key)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        tails = (Tails.of(state.get) if state.exists else Tails.empty()).since(now - expiry_ms)
        rows = pd.concat(list(parts), ignore_index=True)
        rows["_owner"] = rows.groupby(keys, dropna=False, sort=False).ngroup()
        rows = rows.sort_values(["_owner", *names], ascending=[True, *ascending],
                                kind="stable", ignore_index=True)
        owner = rows["_owner"].to_numpy()
        firsts = rows.loc[np.flatnonzero(np.diff(owner, prepend=-1)), keys]
        labels = [json.dumps([None if pd.isna(v) else str(v) for v in k])
                  for k in firsts.itertuples(index=False)]
        derived, tails = advance(tails, labels, owner, {
            v: rows[v].to_numpy(dtype=float, na_value=np.nan) for v in VALUES}, now)
        state.update(tails.row())
        yield rows[base].assign(**derived)

    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets))
    return readings.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
