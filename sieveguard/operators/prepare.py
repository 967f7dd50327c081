"""Splits, anomaly injection and audits for building labelled feature tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveguard.operators.ordering import (
    SLICE_ROWS, before_cut, order_cuts, ordered_sequence)
from sieveguard.scratch import written

ORDER = ("ts", "event_id")
SPLITS = ("train", "val", "test")
# Plans of up to this many blocks are broadcast.
PLAN_BROADCAST_BLOCKS = 20_000
BUCKET = 256              # positions of a bucket; longer than any block
PLAN_CHUNK = 10_000

_MODULUS = 2_147_483_647


def uniform(position: Column, seed: int, stream: int) -> Column:
    """A repeatable number in [0, 1) from a row position: integer arithmetic only, so
    it does not depend on partitioning."""
    return _mixed(position, seed, stream) / float(_MODULUS)


def _mixed(position: Column, seed: int, stream: int) -> Column:
    start = position.cast("long") * 7919 + F.lit(seed * 104_729 + stream * 15_485_863)
    once = (start % _MODULUS) * 48_271 % _MODULUS
    return once * once % _MODULUS


def chronological_split(df: DataFrame, fractions: Sequence[float] = (0.6, 0.2, 0.2),
                        order: Sequence[str] = ORDER,
                        slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``split`` by position in time: the first share trains, the next validates,
    the rest tests.

    Only the two border rows are searched; the split itself is a projection.
    """
    total = df.count()
    ends = [int(total * fractions[0]), int(total * (fractions[0] + fractions[1]))]
    split = F.lit(SPLITS[2])
    for name, cut in reversed(list(zip(SPLITS, order_cuts(df, order, ends, slice_rows)))):
        split = F.when(F.lit(True) if cut is None else before_cut(order, cut),
                       name).otherwise(split)
    return df.withColumn("split", split)


def _positioned(df: DataFrame, order: Sequence[str], scope: str,
                key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if scope not in ("global", "sensor"):
        raise ValueError("scope must be global or sensor")
    by = list(key) if scope == "sensor" else []
    return ordered_sequence(df, order, by), by


def _pick_rows(rows: DataFrame, share: float, seed: int, total: int) -> Column:
    """Exactly int(total * share) rows by the smallest mixed position.

    Positions are 0 to total - 1, so the border is searched among numbers, not in the table.
    """
    count = int(total * share)
    draw = rows.sparkSession.range(total).select(F.col("id").alias("_gpos")).withColumn(
        "_draw", _mixed(F.col("_gpos"), seed, 0))
    cut = order_cuts(draw, ["_draw", "_gpos"], [count])[0]
    if cut is None:
        return F.lit(count > 0)
    here = _mixed(F.col("_gpos"), seed, 0)
    return (here < cut["_draw"]) | ((here == cut["_draw"]) & (F.col("_gpos") < cut["_gpos"]))


def inject_spikes(df: DataFrame, rate: float = 0.012, seed: int = 42,
                  order: Sequence[str] = ORDER) -> DataFrame:
    """Shocks int(rate * n) rows: half in temperature (8 to 20, 70 % upwards), half as a
    voltage drop (0.4 to 0.9, not below 1.8)."""
    rows = ordered_sequence(df, order, name="_gpos")
    return _shocked(rows, _pick_rows(rows, rate, seed, rows.count()), seed).drop("_gpos")


def _shocked(rows: DataFrame, hit: Column, seed: int) -> DataFrame:
    pos = F.col("_gpos")
    hot = uniform(pos, seed, 1) > 0.5
    shock = (F.lit(8.0) + 12.0 * uniform(pos, seed, 2)) * F.when(
        uniform(pos, seed, 3) > 0.3, 1.0).otherwise(-1.0)
    drop = F.lit(0.4) + 0.5 * uniform(pos, seed, 4)
    return rows.withColumn("_hit", hit).withColumns({
        "temperature": F.when(F.col("_hit") & hot, F.col("temperature") + shock)
        .otherwise(F.col("temperature")),
        "voltage": F.when(F.col("_hit") & ~hot, F.greatest(F.lit(1.8), F.col("voltage") - drop))
        .otherwise(F.col("voltage")),
        "spike_type": F.when(F.col("_hit"), F.when(hot, "SPIKE_TEMP")
                             .otherwise("SPIKE_VOLT_DROP")),
    }).drop("_hit")


def _sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_size"))


def block_plan(sizes: DataFrame, share: float, mean_length: int, seed: int, stream: int,
               first: int, tail: int, shortest: int, longest: int,
               by: Sequence[str] = ()) -> DataFrame:
    """Injection blocks ``(block, start, length, slope)`` for tables of the given sizes.

    int(size * share / mean_length) blocks each; starts lie in [first, size - tail).
    """
    count = F.floor(F.col("_size") * share / mean_length)
    count = F.when(F.col("_size") - tail - first > 0, count).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    plan = sizes.withColumn("_count", count).where("_count > 0")
    # Two steps, spread in between: one size may stand for very many blocks.
    plan = plan.withColumn("_chunk", F.explode(F.sequence(
        zero, F.floor((F.col("_count") - 1) / PLAN_CHUNK)))).repartition(*by, "_chunk")
    plan = plan.withColumn("block", F.explode(F.sequence(
        F.col("_chunk") * PLAN_CHUNK,
        F.least(F.col("_count"), (F.col("_chunk") + 1) * PLAN_CHUNK) - 1)))
    b = F.col("block")
    if by:
        b = b + F.pmod(F.xxhash64(*by), F.lit(1_000_003)) * 1009
    room = F.col("_size") - (tail + first)
    return plan.select(
        *by, "block",
        (F.lit(first) + F.floor(uniform(b, seed, stream) * room)).cast("long").alias("start"),
        (F.lit(shortest) + F.floor(uniform(b, seed, stream + 1) * (longest - shortest)))
        .cast("long").alias("length"),
        (F.lit(0.2) + 0.3 * uniform(b, seed, stream + 2)).alias("slope"))


DRIFT = {"mean_length": 40, "stream": 10, "first": 100, "tail": 60, "shortest": 25, "longest": 45}
FLAT = {"mean_length": 25, "stream": 20, "first": 100, "tail": 40, "shortest": 15, "longest": 30}


def _bucket(position: Column) -> Column:
    return F.floor(position / BUCKET).cast("long")


def block_index(plan: DataFrame, by: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """Blocks by the buckets of BUCKET positions that they touch: (_bucket, _blocks), an array by
    block number. A block is shorter than a bucket, so it is in two of them at most; a bucket
    holds as many blocks as the rate puts there.
    """
    last = _bucket(F.col("start") + F.col("length") - 1)
    touched = plan.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        _bucket(F.col("start")), last))))
    return touched.groupBy(*by, "_bucket").agg(F.sort_array(F.collect_list(
        F.struct("block", "start", "length", *fields))).alias("_blocks"))


def _covering(blocks: str, position: Column) -> Column:
    """The blocks of a bucket that cover a position, by block number."""
    return F.filter(blocks, lambda b: (b["start"] <= position)
                    & (position < b["start"] + b["length"]))


def _indexed(rows: DataFrame, index: DataFrame, by: Sequence[str], position: str,
             n_blocks: int) -> DataFrame:
    """Rows with the blocks of their bucket; an index of few blocks is broadcast."""
    placed = rows.withColumn("_bucket", _bucket(F.col(position)))
    small = n_blocks <= PLAN_BROADCAST_BLOCKS
    return placed.join(F.broadcast(index) if small else index, [*by, "_bucket"],
                       "left").drop("_bucket")


def injection_range_join(rows: DataFrame, plan: DataFrame, position: str = "_pos",
                         by: Sequence[str] = ()) -> DataFrame:
    """Rows inside any planned block, once per block, with their step in it."""
    held = _indexed(rows, block_index(plan, by, ["slope"]), by, position,
                    PLAN_BROADCAST_BLOCKS + 1)
    hit = held.withColumn("_hit", F.explode(_covering("_blocks", F.col(position)))).drop("_blocks")
    return hit.withColumns({"slope": F.col("_hit.slope"), "block": F.col("_hit.block"),
                            "step": F.col(position) - F.col("_hit.start")}).drop("_hit")


def _drift(rows: DataFrame, rate: float, seed: int, sizes: DataFrame, total: int,
           by: Sequence[str]) -> DataFrame:
    plan = block_plan(sizes, rate, seed=seed, by=by, **DRIFT)
    joined = _indexed(rows, block_index(plan, by, ["slope"]), by, "_pos",
                      int(total * rate / DRIFT["mean_length"]))
    pos = F.col("_pos")
    hits = joined.withColumn("_hits", _covering("_blocks", pos))
    rise = F.aggregate("_hits", F.lit(0.0), lambda a, b: a + (pos - b["start"]) * b["slope"])
    hit = F.coalesce(F.size("_hits") > 0, F.lit(False))
    return hits.withColumns({
        "temperature": F.when(hit, F.col("temperature") + rise).otherwise(F.col("temperature")),
        "drift_type": F.when(hit, "DRIFT"),
    }).drop("_blocks", "_hits")


def _flat_sources(plan: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each block the position whose readings it repeats.

    A block that starts inside an earlier one repeats that block's value, so starts are traced
    back to a raw row; each round halves the longest chain.
    """
    index = block_index(plan, by).withColumnRenamed("_blocks", "_near")
    near = plan.withColumn("_bucket", _bucket(F.col("start"))).join(index, [*by, "_bucket"])
    before = F.filter("_near", lambda b: (b["block"] < F.col("block")) & (b["start"] <= F.col("start"))
                      & (F.col("start") < b["start"] + b["length"]))
    linked = written(near.select(*by, "block", "start", F.coalesce(
        F.try_element_at(before, F.lit(-1))["block"], F.col("block")).alias("_root")), "flat_roots")
    roots = linked.drop("start")
    while not roots.where("_root <> block").join(
            roots.where("_root <> block").select(*by, F.col("block").alias("_root")),
            [*by, "_root"], "left_semi").isEmpty():
        up = roots.select(*by, F.col("block").alias("_root"), F.col("_root").alias("_next"))
        roots = written(roots.join(up, [*by, "_root"]).select(
            *by, "block", F.col("_next").alias("_root")), "flat_roots")
    starts = linked.select(*by, F.col("block").alias("_root"), F.col("start").alias("_source"))
    return roots.join(starts, [*by, "_root"]).drop("_root")


def _flatline(rows: DataFrame, rate: float, seed: int, sizes: DataFrame, total: int,
              by: Sequence[str], edit: Callable[[DataFrame], DataFrame] = lambda df: df
              ) -> DataFrame:
    """Later blocks win where blocks overlap. ``edit`` changes rows one by one beforehand; it
    is applied to all rows, and to the few whose readings are repeated."""
    plan = written(block_plan(sizes, rate, seed=seed, by=by, **FLAT).drop("slope"), "flat_plan")
    few = int(total * rate / FLAT["mean_length"])
    sources = _flat_sources(plan, by)
    small = few <= PLAN_BROADCAST_BLOCKS
    at = sources.select(*by, F.col("_source").alias("_pos")).distinct()
    raw = edit(rows.join(F.broadcast(at) if small else at, [*by, "_pos"], "left_semi"))
    held = sources.withColumnRenamed("_source", "_pos").join(
        raw.select(*by, "_pos", F.col("temperature").alias("_t"), F.col("voltage").alias("_v")),
        [*by, "_pos"]).drop("_pos")
    index = block_index(plan.join(held, [*by, "block"]), by, ["_t", "_v"])
    joined = _indexed(edit(rows), index, by, "_pos", few).withColumn(
        "_last", F.try_element_at(_covering("_blocks", F.col("_pos")), F.lit(-1)))
    stuck = F.col("_last").isNotNull()
    return joined.withColumns({
        "temperature": F.when(stuck, F.col("_last._t")).otherwise(F.col("temperature")),
        "voltage": F.when(stuck, F.col("_last._v")).otherwise(F.col("voltage")),
        "flat_type": F.when(stuck, "FLATLINE"),
    }).drop("_blocks", "_last")


def _prepared(df: DataFrame, order: Sequence[str], scope: str, key: Sequence[str]):
    rows, by = _positioned(df, order, scope, key)
    rows = rows.withColumnRenamed("pos", "_pos")
    if by:  # per sensor, positions cost a join that later passes should not repeat
        rows = written(rows, "positions")
    sizes = _sizes(rows, by)
    return rows, by, sizes, rows.count()


def inject_drift(df: DataFrame, rate: float = 0.010, seed: int = 42, scope: str = "global",
                 order: Sequence[str] = ORDER, key: Sequence[str] = ("moteid",)) -> DataFrame:
    """Ramps of 25 to 44 rows on temperature; overlapping ramps add up."""
    rows, by, sizes, total = _prepared(df, order, scope, key)
    return _drift(rows, rate, seed, sizes, total, by).drop("_pos")


def inject_flatline(df: DataFrame, rate: float = 0.008, seed: int = 42, scope: str = "global",
                    order: Sequence[str] = ORDER, key: Sequence[str] = ("moteid",)) -> DataFrame:
    """Runs of 15 to 29 rows stuck at the readings of their first row."""
    rows, by, sizes, total = _prepared(df, order, scope, key)
    return _flatline(rows, rate, seed, sizes, total, by).drop("_pos")


def anomaly_label(df: DataFrame) -> DataFrame:
    """``label`` and ``anomaly_type`` from the injection columns; the last edit names it."""
    kind = F.coalesce("flat_type", "drift_type", "spike_type")
    return df.withColumns({
        "anomaly_type": F.coalesce(kind, F.lit("NORMAL")),
        "label": F.when(kind.isNotNull(), 1).otherwise(0),
    }).drop("flat_type", "drift_type", "spike_type")


def inject_anomalies(df: DataFrame, seed: int = 42, spikes: float = 0.012,
                     drift: float = 0.010, flatline: float = 0.008, scope: str = "global",
                     order: Sequence[str] = ORDER, key: Sequence[str] = ("moteid",)) -> DataFrame:
    """Spikes, then drifts, then flatlines, with labels."""
    rows, by, sizes, total = _prepared(df, order, scope, key)
    if by:
        rows = ordered_sequence(rows, order, name="_gpos")
    else:
        rows = rows.withColumn("_gpos", F.col("_pos"))
    hit = _pick_rows(rows, spikes, seed, total)

    def edit(part: DataFrame) -> DataFrame:
        return _drift(_shocked(part, hit, seed), drift, seed, sizes, total, by)

    return anomaly_label(_flatline(rows, flatline, seed, sizes, total, by, edit)).drop(
        "_pos", "_gpos")


def split_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min(ts).alias("min_ts"),
                                   F.max(ts).alias("max_ts"))


def leakage_audit(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per neighbouring pair of splits; touching borders pass."""
    flat = df.agg(*[f(F.when(F.col("split") == s, F.col(ts))).alias(f"{n}_{s}")
                    for s in SPLITS for n, f in (("lo", F.min), ("hi", F.max))])
    return flat.select(F.expr(
        "stack(2, 'train', 'val', hi_train, lo_val, 'val', 'test', hi_val, lo_test)"
        " as (earlier, later, max_earlier, min_later)")).withColumn(
        "passed", F.col("max_earlier") <= F.col("min_later"))


def clean_train_check(df: DataFrame) -> DataFrame:
    train = df.where(F.col("split") == "train")
    return train.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("labels"),
        F.count_if(F.col("anomaly_type") != "NORMAL").alias("not_normal")).withColumn(
        "passed", (F.col("labels") == 0) & (F.col("not_normal") == 0))


def prevalence_check(df: DataFrame, lo: float = 0.02, hi: float = 0.04) -> DataFrame:
    return df.where(F.col("split").isin("val", "test")).groupBy("split").agg(
        F.avg("label").alias("prevalence")).withColumn(
        "passed", F.col("prevalence").between(lo, hi))
