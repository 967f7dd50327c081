"""Row-framed window features per sensor.

A window partition is one sensor, so one very busy sensor would be one very long
task.  Every operator here therefore checks the sensor sizes first (an aggregation
over the key column only) and gives busy sensors another plan with equal results:

1. range-partition the busy rows by (sensor, order), which cuts a sensor into blocks,
   and write them, so block numbers are fixed;
2. compute the windows inside (sensor, block); every row with enough rows before it in
   its own block is final;
3. recompute only the block heads over the rows near block borders.

All other sensors take one shuffle and one sort for every frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.operators.ordering import (
    BLOCK, INDEX, before_cut, order_cuts, ordered_blocks, sort_columns, split_order)

# A sensor with more rows than this is computed in blocks.
BUSY_ROWS = 5_000_000
# A list of busy sensors up to this length is broadcast.
BUSY_KEYS_BROADCAST = 20_000

ORDER = ("ts", "event_id")

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def busy_keys(df: DataFrame, key: Sequence[str], busy_rows: int) -> DataFrame | None:
    """Keys with more than ``busy_rows`` rows, or None when there are none.

    There can be at most rows / busy_rows of them; a list up to the checked length
    comes back as a broadcast table.
    """
    heavy = df.groupBy(*key).count().where(F.col("count") > busy_rows).drop("count")
    head = heavy.limit(BUSY_KEYS_BROADCAST + 1).collect()
    if not head:
        return None
    if len(head) > BUSY_KEYS_BROADCAST:
        return heavy
    return F.broadcast(df.sparkSession.createDataFrame(head, heavy.schema))


def _same_key(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column]:
    named = keys.select(*[F.col(c).alias(f"_busy_{c}") for c in key])
    test = F.lit(True)
    for c in key:
        test = test & df[c].eqNullSafe(named[f"_busy_{c}"])
    return named, test


def over_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], reach: int,
              build: Build, busy_rows: int | None = BUSY_ROWS) -> DataFrame:
    """Apply ``build(df, window)`` per key, where a row needs ``reach`` rows before it.

    ``build`` must use only the given window (ordered, without a frame) and frames that
    end at the current row.  ``busy_rows=None`` skips the size check.
    """
    plain = Window.partitionBy(*key).orderBy(*sort_columns(order))
    busy = busy_keys(df, key, busy_rows) if busy_rows else None
    if busy is None:
        return build(df, plain)
    keys, same = _same_key(df, busy, key)
    calm = build(df.join(keys, same, "left_anti"), plain)
    blocks = ordered_blocks(df.join(keys, same, "left_semi"), [*key, *order], "busy")
    # Where each sensor begins and ends in a block: at most one row per block and per
    # busy sensor, so this has the bound of the sensor list.
    cells = blocks.groupBy(*key, BLOCK).agg(F.min(INDEX).alias("_first"),
                                            F.max(INDEX).alias("_last"))
    cells = cells.select(*[F.col(c).alias(f"_cell_{c}") for c in (*key, BLOCK)],
                         "_first", "_last")
    here = F.lit(True)
    for c in (*key, BLOCK):
        here = here & F.col(c).eqNullSafe(F.col(f"_cell_{c}"))
    bounded = busy.count() <= BUSY_KEYS_BROADCAST
    placed = blocks.join(F.broadcast(cells) if bounded else cells, here).withColumns({
        "_nth": F.col(INDEX) - F.col("_first"), "_left": F.col("_last") - F.col(INDEX)})
    in_block = Window.partitionBy(*key, BLOCK).orderBy(INDEX)
    body = build(placed, in_block).where(F.col("_nth") >= reach)
    # Only rows near block borders move again.
    border = placed.where((F.col("_nth") < reach) | (F.col("_left") < reach))
    heads = build(border, plain).where(F.col("_nth") < reach)
    extra = [BLOCK, INDEX, "_nth", "_left", *cells.columns]
    return calm.unionByName(body.drop(*extra)).unionByName(heads.drop(*extra))


def _finite(name: str) -> Column:
    """NaN counts as missing inside windows."""
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def _rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def rolling_stats(df: DataFrame, col: str, rows: int, min_rows: int = 1,
                  key: Sequence[str] = ("moteid",), order: Sequence[str] = ORDER,
                  default_std: float | None = None,
                  busy_rows: int | None = BUSY_ROWS) -> DataFrame:
    """Count, mean, sample deviation and variance of the last ``rows`` values.

    The mean is null below ``min_rows`` values; the deviation then is ``default_std``.
    """
    def build(part: DataFrame, window: WindowSpec) -> DataFrame:
        frame, x = _rows(window, rows), _finite(col)
        n = F.count(x).over(frame)
        enough = n >= min_rows
        std = F.when(enough, F.stddev_samp(x).over(frame))
        if default_std is not None:
            std = F.coalesce(std, F.lit(default_std))
        return part.withColumns({
            f"{col}_n": n,
            f"{col}_mean": F.when(enough, F.avg(x).over(frame)),
            f"{col}_std": std,
            f"{col}_var": std * std,
        })
    return over_rows(df, key, order, rows - 1, build, busy_rows)


def dual_window_features(df: DataFrame, key: Sequence[str] = ("moteid",),
                         order: Sequence[str] = ORDER, short: int = S.SHORT_ROWS,
                         long: int = S.LONG_ROWS, lag: int = S.SLOPE_LAG,
                         keep_window_columns: bool = False,
                         busy_rows: int | None = BUSY_ROWS) -> DataFrame:
    """Adds the six derived features; with the four readings they form the contract.

    All frames share one window, hence one shuffle and one sort.
    """
    def build(part: DataFrame, window: WindowSpec) -> DataFrame:
        near, far = _rows(window, short), _rows(window, long)
        t, v = _finite("temperature"), _finite("voltage")
        stats = part.withColumns({
            "short_temp_mean": F.avg(t).over(near),
            "short_volt_mean": F.avg(v).over(near),
            "_nt": F.count(t).over(far),
            "_nv": F.count(v).over(far),
            "long_temp_mean": F.avg(t).over(far),
            "long_volt_mean": F.avg(v).over(far),
            "long_temp_std": F.stddev_samp(t).over(far),
            "long_volt_std": F.stddev_samp(v).over(far),
            "_lagged": F.lag(t, lag).over(window),
        })
        warm_t = F.col("_nt") >= S.MIN_LONG_VALUES
        warm_v = F.col("_nv") >= S.MIN_LONG_VALUES
        stats = stats.withColumns({
            "long_temp_mean": F.when(warm_t, F.col("long_temp_mean")),
            "long_volt_mean": F.when(warm_v, F.col("long_volt_mean")),
            "long_temp_std": F.when(warm_t, F.col("long_temp_std"))
            .otherwise(S.WARMUP_TEMP_STD),
            "long_volt_std": F.when(warm_v, F.col("long_volt_std"))
            .otherwise(S.WARMUP_VOLT_STD),
        })
        zero = F.lit(0.0)
        done = stats.withColumns({
            "delta_temp_3m": t - F.col("short_temp_mean"),
            "delta_volt_3m": v - F.col("short_volt_mean"),
            "z_temp_15m": F.coalesce(
                (t - F.col("long_temp_mean")) / (F.col("long_temp_std") + S.STD_EPSILON), zero),
            "z_volt_15m": F.coalesce(
                (v - F.col("long_volt_mean")) / (F.col("long_volt_std") + S.STD_EPSILON), zero),
            "temp_slope_15m": F.coalesce((t - F.col("_lagged")) / float(lag), zero),
            "var_temp_15m": F.col("long_temp_std") * F.col("long_temp_std"),
        }).drop("_nt", "_nv", "_lagged")
        if keep_window_columns:
            return done
        return done.drop("short_temp_mean", "short_volt_mean", "long_temp_mean",
                         "long_volt_mean", "long_temp_std", "long_volt_std")
    return over_rows(df, key, order, max(short, long, lag + 1) - 1, build, busy_rows)


def expanding_stats(df: DataFrame, col: str, key: Sequence[str] = ("moteid",),
                    order: Sequence[str] = ORDER, min_std: float = 1e-6,
                    busy_rows: int | None = BUSY_ROWS) -> DataFrame:
    """Running count, mean, sample variance and deviation, and |x - mean| / std.

    Busy sensors are cut into blocks; a row merges the moments of its own block so far
    with those of all earlier blocks.
    """
    def finish(part: DataFrame) -> DataFrame:
        std = F.sqrt(f"{col}_run_var")
        gap = F.abs(F.col(col) - F.col(f"{col}_run_mean"))
        return part.withColumns({
            f"{col}_run_std": std,
            f"{col}_run_z": F.when(std > min_std, gap / std).otherwise(0.0),
        })

    def plain(part: DataFrame) -> DataFrame:
        frame = Window.partitionBy(*key).orderBy(*sort_columns(order)).rowsBetween(
            Window.unboundedPreceding, 0)
        x = _finite(col)
        n = F.count(x).over(frame)
        return finish(part.withColumns({
            f"{col}_run_n": n,
            f"{col}_run_mean": F.avg(x).over(frame),
            f"{col}_run_var": F.when(n > 1, F.var_samp(x).over(frame)).otherwise(0.0),
        }))

    busy = busy_keys(df, key, busy_rows) if busy_rows else None
    if busy is None:
        return plain(df)
    keys, same = _same_key(df, busy, key)
    calm = plain(df.join(keys, same, "left_anti"))

    blocks = ordered_blocks(df.join(keys, same, "left_semi"), [*key, *order], "busy")
    wrapped = {f"_k{i}": F.struct(F.col(c)) for i, c in enumerate(key)}
    blocks = blocks.withColumns({"_x": _finite(col), **wrapped})
    frame = Window.partitionBy(*wrapped, BLOCK).orderBy(INDEX).rowsBetween(
        Window.unboundedPreceding, 0)
    local = blocks.withColumns({
        "_n": F.count("_x").over(frame),
        "_mean": F.avg("_x").over(frame),
        "_m2": F.var_pop("_x").over(frame) * F.count("_x").over(frame),
    })
    cells = blocks.groupBy(*wrapped, BLOCK).agg(
        F.count("_x").alias("n"), F.coalesce(F.avg("_x"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("_x") * F.count("_x"), F.lit(0.0)).alias("s"))
    group = Window.partitionBy(*wrapped)
    ahead = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # Block means are centred on the sensor mean before squaring, for accuracy.
    centred = cells.withColumn(
        "c", F.sum(F.col("n") * F.col("m")).over(group)
        / F.nullif(F.sum("n").over(group), F.lit(0)))
    centred = centred.withColumn("d", F.col("m") - F.coalesce("c", F.lit(0.0)))
    zero = F.lit(0.0)
    prior = centred.select(
        *wrapped, BLOCK, "c",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_pn"),
        F.coalesce(F.sum(F.col("n") * F.col("d")).over(ahead), zero).alias("_pd"),
        F.coalesce(F.sum(F.col("s") + F.col("n") * F.col("d") * F.col("d")).over(ahead),
                   zero).alias("_pq"))
    both = local.join(prior, [*wrapped, BLOCK])
    pn, ln = F.col("_pn"), F.col("_n")
    shift = F.coalesce("c", zero)
    p_mean = F.when(pn > 0, F.col("_pd") / F.nullif(pn, F.lit(0)) + shift).otherwise(0.0)
    p_m2 = F.when(pn > 0, F.col("_pq") - F.col("_pd") * F.col("_pd")
                  / F.nullif(pn, F.lit(0))).otherwise(0.0)
    l_mean, l_m2 = F.coalesce("_mean", zero), F.coalesce("_m2", zero)
    both = both.withColumns({"_pmean": p_mean, "_pm2": p_m2, "_all": pn + ln})
    share = F.col("_all")
    gap = l_mean - F.col("_pmean")
    m2 = F.col("_pm2") + l_m2 + gap * gap * pn * ln / F.nullif(share, F.lit(0))
    merged = both.withColumns({
        f"{col}_run_n": share,
        f"{col}_run_mean": F.when(
            share > 0, F.col("_pmean") + gap * ln / F.nullif(share, F.lit(0))),
        f"{col}_run_var": F.when(
            share > 1, m2 / F.nullif(share - 1, F.lit(0))).otherwise(0.0),
    }).select(*calm.columns[:-2])
    return calm.unionByName(finish(merged))


def context_window(df: DataFrame, anomaly_type: str, nth: int, before: int = 50,
                   after: int = 50, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows around the nth (0-based) anomaly of a type: ``before`` rows ahead of it,
    then ``after`` rows from it on, with their offset from the anomaly.

    The anchor is one row; both sides are top-n queries bounded by it.
    """
    names = [split_order(o)[0] for o in order]
    anchor = order_cuts(df.where(F.col("anomaly_type") == anomaly_type).select(*names),
                        order, [nth])[0]
    if anchor is None:
        return df.limit(0).withColumn("offset", F.lit(0))
    ahead = before_cut(order, anchor)
    flipped = [n if down else f"-{n}" for n, down in map(split_order, order)]
    left = df.where(ahead).orderBy(*sort_columns(flipped)).limit(before)
    right = df.where(~ahead).orderBy(*sort_columns(order)).limit(after)
    # At most before / after rows each: the windows below are over those only.
    left = left.withColumn("offset", -F.row_number().over(
        Window.orderBy(*sort_columns(flipped))))
    right = right.withColumn("offset", F.row_number().over(
        Window.orderBy(*sort_columns(order))) - 1)
    return left.unionByName(right)
