"""Token ids as one wavelet matrix per shard.

A shard holds the ids of some documents in order. Its wavelet matrix has one bit-plane per id
bit, highest first; each plane's ones and zeros send the ids, in order, to the two halves of
the next plane. With counts of ones at every RANK_STEP bits, the planes answer access (the id
at a place), rank (how often an id occurs before a place), count, and select (where it occurs
for the k-th time), all without unpacking. The ids need as many bits as the vocabulary asks for.

The file format is Parquet, a row per shard: shard number, ids, zeros of each plane, planes and
their rank counts, and the documents' ids and lengths (an end id may also occur inside a text,
so lengths are stored, not searched for). Shards follow the order of doc_id; shard numbers grow
with it. Documents are never cut; a shard ends with the document that fills it.

Nulls: a null text counts as empty and holds the end id alone; null doc_ids come first. Repeated
rows are kept. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import sized_batches, table
from sieveguard.llm.encoders import WordEncoder, word_encoder
from sieveguard.llm.registry import query
from sieveguard.scratch import scratch_path

SHARD_IDS = 1 << 20       # ids after which a shard is full
RANK_STEP = 512           # bits between two stored counts
SHARD_SCHEMA = ("shard long, n long, zeros array<long>, planes array<binary>,"
                " ranks array<binary>, doc_ids array<long>, doc_lengths array<long>")


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks
        self._counts = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError("an id needs more bits")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(packed) // (RANK_STEP // 8)) * (RANK_STEP // 8), np.uint8)
            padded[:len(packed)] = packed
            steps = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_STEP // 64).sum(axis=1)
            counts = np.zeros(len(steps) + 1, np.uint32)
            np.cumsum(steps, out=counts[1:])
            # Places first, then take: several times as fast as a mask over random bits.
            low = now.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            planes.append(packed.tobytes())
            ranks.append(counts.tobytes())
            now = np.concatenate([low, now.take(np.flatnonzero(ones))])
        return cls(len(ids), zeros, planes, ranks)

    def ids(self) -> np.ndarray:
        """All ids in order."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        low = np.zeros(self.n, kind)
        for back in range(bits):
            level = bits - 1 - back
            ones = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n,
                                 bitorder="little").view(bool)
            now = np.empty(self.n, kind)
            now[np.flatnonzero(~ones)] = low[:self.zeros[level]]
            now[np.flatnonzero(ones)] = low[self.zeros[level]:] | kind(1 << back)
            low = now
        return low

    def _bit(self, level: int, at: int) -> int:
        return self.planes[level][at >> 3] >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before place ``at``."""
        step = at // RANK_STEP
        part = self.planes[level][step * RANK_STEP // 8:(at + 7) // 8]
        rest = int.from_bytes(part, "little") & ((1 << (at - step * RANK_STEP)) - 1)
        return int(self._counts[level][step]) + rest.bit_count()

    def _next(self, level: int, bit: int, at: int) -> int:
        ones = self._ones(level, at)
        return self.zeros[level] + ones if bit else at - ones

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, at)
            value = value << 1 | bit
            at = self._next(level, bit, at)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the id's occurrences before ``end`` stand below the last plane."""
        bits = len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        low, high = 0, end
        for level in range(bits):
            bit = token >> (bits - 1 - level) & 1
            low, high = self._next(level, bit, low), self._next(level, bit, high)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs in the first ``end`` places."""
        low, high = self._range(token, min(max(end, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th one (or zero) of a plane."""
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            ones = self._ones(level, middle)
            if (ones if bit else middle - ones) <= k:
                low = middle
            else:
                high = middle
        return low


def write_shards(docs: DataFrame, path: str, encoder: WordEncoder, end_id: int,
                 bits: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs(doc_id, text)`` in order of doc_id into shards at ``path``."""
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions(
        "doc_id", "_h", "text").select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        parts: list[np.ndarray] = []
        names: list = []
        held = 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(parts), bits)
            row = {"shard": first + made, "n": matrix.n, "zeros": matrix.zeros,
                   "planes": matrix.planes, "ranks": matrix.ranks, "doc_ids": names,
                   "doc_lengths": [len(p) for p in parts]}
            return pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

        end = np.array([end_id], np.uint32)
        for batch in sized_batches(batches, "text", 4 << 20):
            ids = batch.column(0).to_pylist()
            for doc_id, found in zip(ids, shared.value.encode(batch.column(1).to_pylist())):
                parts.append(np.concatenate([found, end]))
                names.append(doc_id)
                held += len(parts[-1])
                if held >= shard_ids:
                    yield close()
                    made, held = made + 1, 0
                    parts.clear()
                    names = []
        if parts:
            yield close()

    ordered.mapInArrow(pack, SHARD_SCHEMA).write.parquet(path)


SHARD_ARROW = pa.schema([
    ("shard", pa.int64()), ("n", pa.int64()), ("zeros", pa.list_(pa.int64())),
    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before each. One row per task, then per shard in it."""
    task = F.shiftright("shard", 32)
    sizes = shards.select("shard", "n", task.alias("task"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = sizes.groupBy("task").agg(F.sum("n").alias("all")).select("task", F.coalesce(
        F.sum("all").over(before(Window.orderBy("task"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("task").orderBy("shard"))),
                        F.lit(0))
    return sizes.withColumn("inside", inside).join(tasks, "task").select(
        "shard", (F.col("ahead") + F.col("inside")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the planes of the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = WaveletMatrix(row["n"], row["zeros"], row["planes"], row["ranks"]).ids()
                data = memoryview(ids.astype("<u4")).cast("B")
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ends), pa.int64()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths),
                     pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(unpack, "shard long, doc_id long, offset long, n_tokens long,"
                                      " ids_crc32 long")
    return found.join(shard_starts(shards), "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op10_token_store")
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_store")
    write_shards(table(spark, sf_dir, "documents"), path, word_encoder(), end_id=1, bits=16)
    return read_documents(spark, path)
