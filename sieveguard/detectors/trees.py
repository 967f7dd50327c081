"""Decision-tree node tables and their vectorised walk.

A node table has one row per node: ``tree, node, feature, threshold, left, right,
value``.  Children of a leaf point at the leaf itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int,"
               " value double")


# Arrays of one tree: feature, threshold, left, right, value.
Tree = tuple[np.ndarray, ...]


def tree_arrays(nodes: pd.DataFrame) -> list[Tree]:
    """Node arrays per tree: plain arrays, so that they travel without this package."""
    names = ["feature", "threshold", "left", "right", "value"]
    return [tuple(part[c].to_numpy() for c in names)
            for _, part in nodes.sort_values(["tree", "node"]).groupby("tree")]


def leaf_sum(trees: list[Tree], x: np.ndarray, strict: bool) -> np.ndarray:
    """Sum of leaf values.  ``strict``: left when x < threshold, else x <= threshold."""
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            here, limit = x[rows, feature[at]], threshold[at]
            nxt = np.where(here < limit if strict else here <= limit, left[at], right[at])
            if (nxt == at).all():
                break
            at = nxt
        out += value[at]
    return out


def collect_trees(nodes: DataFrame, limit: int) -> list[Tree]:
    """Bring a node table to the driver after checking its size."""
    rows = nodes.select("tree", "node", "feature", "threshold", "left", "right",
                        "value").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"node table has more than {limit} nodes")
    return tree_arrays(rows)


def matrix(frame: pd.DataFrame) -> np.ndarray:
    """Feature matrix with missing and non-finite values as 0."""
    x = frame.to_numpy(dtype=np.float64, na_value=np.nan)
    return np.where(np.isfinite(x), x, 0.0)


def batches(parts: Iterator[pd.DataFrame], score) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series(score(matrix(part)))
