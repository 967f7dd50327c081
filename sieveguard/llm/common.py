"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_batches(batches: Iterator[pa.RecordBatch], column: str,
                  limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each.

    A single longer value stays whole, in a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, np.int64)
        width = np.frombuffer(values.buffers()[1], np.int32 if values.type in
                              (pa.string(), pa.binary()) else np.int64)
        ends = width[values.offset:values.offset + batch.num_rows + 1].astype(np.int64)
        sizes[:] = np.diff(ends)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        yield batch.slice(start)


def unsigned_hex(c: Column) -> Column:
    """A long as 16 lowercase hex digits of its bits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def clear_names(df: DataFrame, names: list[str]) -> None:
    """Refuse a frame whose columns clash with those the operator adds."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns in use: {sorted(clash)}")


def checked_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that is small by contract; one row over the limit is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
