"""Token counts of documents in flat token files, from their end-of-document ids alone.

A flat file is a run of ids, cut into blocks anywhere, without an index. Every block is
searched for the end id in one vector operation. What a block tells the others is one short
row: its ids, its ends, and the ids after its last end. A prefix scan over these rows gives
each block the ids carried in from before and its place in the whole, which completes the
document that crosses into it, however many blocks it crosses.

A file that does not stop with an end id has one more document, marked as not ended. Two ends
in a row enclose an empty document. Null or empty blocks hold no ids. Empty input gives an empty
result. Repeated rows of a table are documents of their own; null texts are empty documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import sized_batches, table
from sieveguard.llm.encoders import RankEncoder, rank_encoder
from sieveguard.llm.registry import query
from sieveguard.scratch import scratch_path

BLOCK_IDS = 1 << 18       # ids of a block
WIDTH = "<u2"             # as a numpy type; the ids of the query are below 65,536
END_ID = 50256            # beyond the byte-pair ranks, so no text gives it
BLOCK_SCHEMA = "file long, block long, ids binary, names array<long>"


def write_flat(docs: DataFrame, path: str, encoder: RankEncoder, end_id: int = END_ID,
               block_ids: int = BLOCK_IDS, width: str = WIDTH) -> None:
    """Encode ``docs(doc_id, text)`` into flat files at ``path``, one per task.

    A row is a block (little-endian unsigned ids of ``width``); ``names`` are the doc_ids that end
    in it, in order, and tell nothing of where.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, made = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        ends: list[tuple[int, object]] = []  # place in the file, doc_id
        held, done = 0, 0
        stop = np.array([end_id], np.uint32)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, ends, held, done, made
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            while held and (held >= block_ids or last):
                size = min(block_ids, held)
                inside = [n for p, n in ends if p < done + size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([made], pa.int64()),
                     pa.array([data[:size].astype(width).tobytes()], pa.binary()),
                     pa.array([inside], pa.list_(pa.int64()))],
                    names=["file", "block", "ids", "names"])
                ends = ends[len(inside):]
                data, held, done, made = data[size:], held - size, done + size, made + 1
            parts = [data]

        for batch in sized_batches(batches, "text", 4 << 20):
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, shared.value.encode(batch.column(1).to_pylist())):
                parts += [ids, stop]
                held += len(ids) + 1
                ends.append((done + held - 1, name))
                if held >= block_ids:
                    yield from cut(False)
        yield from cut(True)

    docs.select("doc_id", "text").mapInArrow(flatten, BLOCK_SCHEMA).write.parquet(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of raw binary files: each file a block of its own name, without document names."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.xxhash64("path").alias("file"), F.lit(0).cast("long").alias("block"),
                      F.col("content").alias("ids"),
                      F.lit(None).cast("array<long>").alias("names"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, width: str = WIDTH) -> DataFrame:
    """(file, block, rank, at, since, doc_id) of every end, and one row per block (rank -1).

    ``since`` counts the ids from the end before, or from the block's start; in the block's own
    row, ``at`` is its number of ids and ``since`` the ids after its last end.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py() or b""
                names = batch.column(3)[i].as_py()
                ids = np.frombuffer(data, width)
                at = np.flatnonzero(ids == end_id)
                if names is not None and len(names) != len(at):
                    raise ValueError("block and names disagree")
                before = np.concatenate([[-1], at])
                tail = len(ids) - 1 - int(before[-1])
                k = len(at) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * k, pa.int64()),
                     pa.array([batch.column(1)[i].as_py()] * k, pa.int64()),
                     pa.array(np.concatenate([[-1], np.arange(k - 1)]), pa.int64()),
                     pa.array(np.concatenate([[len(ids)], at]), pa.int64()),
                     pa.array(np.concatenate([[tail], at - before[:-1] - 1]), pa.int64()),
                     pa.array([None] + (names or [None] * (k - 1)), pa.int64())],
                    names=["file", "block", "rank", "at", "since", "doc_id"])

    return blocks.select("file", "block", "ids", "names").mapInArrow(
        scan, "file long, block long, rank long, at long, since long, doc_id long")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id, start, n_tokens, ended) of every document.

    ``start`` counts all ids before the document, over files in order; ``n_tokens`` leaves out the
    end id. ``scanned`` is read more than once.
    """
    own = scanned.filter("rank = -1").select(
        "file", "block", F.col("at").alias("n"), F.col("since").alias("tail"))
    ends = scanned.filter("rank >= 0")
    number = ends.groupBy("file", "block").agg(F.count("*").alias("ends"))
    rows = own.join(number, ["file", "block"], "left").fillna(0, ["ends"])
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = rows.withColumn("first", first).withColumn(
        "ordinals", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    last_end = F.when(F.col("ends") > 0, F.col("first") + F.col("n") - F.col("tail"))
    placed = placed.withColumn("carry", F.col("first") - F.coalesce(
        F.max(last_end).over(before), F.lit(0)))
    files = placed.groupBy("file").agg(
        F.sum("n").alias("n"), F.sum("ends").alias("ends"),
        F.coalesce(F.max(last_end), F.lit(0)).alias("last_end"))
    # One row per file.
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    length = F.col("since") + F.when(F.col("rank") == 0, F.col("carry")).otherwise(0)
    whole = (ends.join(placed.select("file", "block", "first", "ordinals", "carry"),
                       ["file", "block"]).join(files.select("file", "base"), "file")
             .withColumn("n_tokens", length).select(
                 "file", (F.col("ordinals") + F.col("rank")).alias("ordinal"), "doc_id",
                 (F.col("base") + F.col("first") + F.col("at") - F.col("n_tokens"))
                 .alias("start"), "n_tokens", F.lit(True).alias("ended")))
    rest = files.filter("n > last_end").select(
        "file", F.col("ends").alias("ordinal"), F.lit(None).cast("long").alias("doc_id"),
        (F.col("base") + F.col("last_end")).alias("start"),
        (F.col("n") - F.col("last_end")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.union(rest)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, scanned = scratch_path(spark, "flat"), scratch_path(spark, "scanned")
    write_flat(table(spark, sf_dir, "documents"), path, rank_encoder())
    scan_blocks(spark.read.schema(BLOCK_SCHEMA).parquet(path)).write.parquet(scanned)
    return stitch(spark.read.parquet(scanned))
