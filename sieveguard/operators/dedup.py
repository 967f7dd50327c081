"""Keeping the last version of each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard import schema as S
from sieveguard.operators.ordering import sort_columns


def latest_by_key(df: DataFrame, key: Sequence[str] = S.EVENT_KEY,
                  order: Sequence[str] = ("-processed_at_epoch_ms",)) -> DataFrame:
    """One row per key, the first in ``order``; a hash of the whole row decides ties, so that a
    repeated task picks the same row.

    Spark limits each key to one row before the shuffle (a partial group limit), so a
    key with very many copies costs one row per input task.
    """
    whole = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    w = Window.partitionBy(*key).orderBy(*sort_columns(order), F.xxhash64(*whole))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int,
                  unique: str, salts: int | None = None) -> DataFrame:
    """The first n rows per group; a group may hold most of the table.

    Each salted part keeps its own first n, so the second step sees at most
    ``salts * n`` rows per group.  The default spreads a group over all reducers, up to
    1024 parts.
    """
    if salts is None:
        salts = min(1024, max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    part = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy(*sort_columns(order))
    last = Window.partitionBy(*by).orderBy(*sort_columns(order))
    return (part.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
            .withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n)
            .drop("_n", "_salt"))
