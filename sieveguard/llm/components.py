"""Connected components of a graph given as a table of edges.

Alternates two contractions: every node hands its larger neighbours to its smallest one, and
then its smaller ones too, until each node has one edge, to the smallest node it can reach.
Both are aggregations and equi-joins over edges; no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveguard.scratch import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction of ``edges(a, b)`` with a > b."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(
            F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(a, b)``: root is the smallest node reachable.

    Nodes without edges are not in the result. Edges may repeat, point either way or to
    themselves; rows with a null end are ignored. Every round is written to the shared
    folder, so a lost executor repeats one round at most.
    """
    now = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
        now = written(_star(_star(now, True), False), "edges")
    raise RuntimeError("components did not settle")
