"""Isolation forest: sampled by Spark, one tree per group, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveguard import schema as S
from sieveguard.detectors.trees import NODE_SCHEMA, batches, collect_trees, leaf_sum
from sieveguard.functions.columns import clean_features
from sieveguard.scratch import written


HASH_SPAN = 1 << 31
# Node tables up to this length (a thousand trees) are sent to tasks.
MAX_NODES = 1_100_000


def mean_path(n: int) -> float:
    """Mean depth of a failed search in a random tree over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def first_share(samples: int, total: int) -> float:
    """Share of rows to rank per tree: a third more than asked for, and a hundred."""
    return (1.3 * samples + 100.0) / max(total, 1)


def draw_samples(df: DataFrame, trees: int, samples: int, seed: int, unique: str) -> DataFrame:
    """For each tree the ``samples`` distinct rows with the smallest draws, a hash of row, seed
    and tree.

    Only draws below a bound are ranked, a few more rows per tree than asked for; where a tree
    falls short, the bound is raised, so that it never changes which rows are taken. Repeated
    deliveries of a row count once.
    """
    total = df.agg(F.approx_count_distinct(unique, 0.01)).first()[0]
    share = first_share(samples, total)
    draw = lambda tree: F.pmod(F.xxhash64(F.col(unique), F.lit(seed), tree), F.lit(HASH_SPAN))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", unique))
    while True:
        bound = F.lit(int(share * HASH_SPAN))
        hits = df.withColumn("tree", F.explode(F.filter(numbers, lambda t: draw(t) < bound)))
        # Repeats of a row have its draws: they meet here, in few rows.
        single = hits.dropDuplicates([unique, "tree"]).withColumn("_draw", draw(F.col("tree")))
        picked = written(single.withColumn("_rank", rank).where(F.col("_rank") <= samples)
                         .drop("_rank"), "forest_rows")
        full = picked.groupBy("tree").count().where(F.col("count") >= samples).count()
        if full == trees or share >= 1.0:
            return picked
        share *= 4


def grow_tree(x: np.ndarray, tree: int, seed: int, height: int) -> pd.DataFrame:
    """One random tree over the rows of x; leaf values are path lengths."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or not len(open_columns):
            nodes.append([0, 0.0, me, me, depth + mean_path(len(rows))])
            continue
        column = int(rng.choice(open_columns))
        cut = float(rng.uniform(low[column], high[column]))
        goes_left = x[rows, column] < cut
        if not goes_left.any():
            cut = float(np.nextafter(low[column], high[column]))
            goes_left = x[rows, column] < cut
        nodes.append([column, cut, -1, -1, 0.0])
        todo.append((rows[~goes_left], depth + 1, me, 3))
        todo.append((rows[goes_left], depth + 1, me, 2))
    out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "value"])
    out.insert(0, "node", np.arange(len(out)))
    out.insert(0, "tree", tree)
    return out


def fit_forest(df: DataFrame, trees: int = 100, samples: int = 512,
               contamination: float = 0.03, seed: int = 42,
               unique: str = "event_id") -> DataFrame:
    """Node table of a fitted forest, with its offset and sample size on each row.

    The offset is the ``contamination`` quantile of the training scores, so that the
    decision score below 0 marks about that share.
    """
    base = clean_features(df.select(unique, *S.FEATURES))
    if trees * 2 * samples > MAX_NODES:
        raise ValueError(f"trees x samples allows more than {MAX_NODES} nodes")
    picked = draw_samples(base, trees, samples, seed, unique)
    # All trees hold ``samples`` rows, or the whole of a smaller table.
    size = picked.where("tree = 0").count()
    if size < 2:
        raise ValueError("a forest needs at least two rows")
    height = ceil(log2(size))
    features = list(S.FEATURES)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["_draw", *features])
        return grow_tree(ordered[features].to_numpy(dtype=np.float64), int(key[0]), seed, height)

    # A fixed partition number: the samples are small, growing trees is the work.
    tasks = min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism)
    grown = picked.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # Written once, so that every later use sees the same trees.
    nodes = written(grown, "forest").withColumns({"samples": F.lit(size), "offset": F.lit(0.0)})
    raw = score_forest(base, nodes, "_raw")
    offset = raw.agg(F.percentile_approx("_raw", contamination, 10_000)).first()[0]
    return nodes.withColumn("offset", F.lit(float(offset)))


def score_forest(df: DataFrame, nodes: DataFrame, name: str = "if_score") -> DataFrame:
    """Adds the decision score; lower means more anomalous."""
    first = nodes.select("samples", "offset").first()
    size, offset = int(first["samples"]), float(first["offset"])
    trees = collect_trees(nodes, MAX_NODES)
    n_trees = len(trees)
    sent = df.sparkSession.sparkContext.broadcast(trees)
    scale = n_trees * mean_path(size)

    @F.pandas_udf("double")
    def decision(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        forest = sent.value
        return batches(parts, lambda x: -np.exp2(-leaf_sum(forest, x, True) / scale) - offset)

    return df.withColumn(name, decision(F.struct(*S.FEATURES)))
