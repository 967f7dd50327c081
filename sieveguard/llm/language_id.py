"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, in every cell, one bit per language: the cells of an n-gram,
combined with AND, give all languages whose filter holds it. A text's n-grams are looked up
together; the bits are counted per language, each count is corrected for the filter's false
positives, and the highest corrected share of the text's n-grams decides.

N-grams are byte n-grams of the lower-cased text in which everything but letters is one
space. A language holds an n-gram that occurs in at least MIN_RATE of its sampled documents
and at a rate of at least MIN_SHARE of the language where it is most usual.

Nulls and texts without a letter are ``und`` with score 0. Texts whose n-grams are all
unknown get the most frequent language with score 0. With no labelled text every prediction
is ``und``. Repeated rows are predicted alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import checked_rows, clear_names, sized_batches, table
from sieveguard.llm.registry import query

SIZES = (3, 4, 5)
PROBES = 3
CELLS_PER_GRAM = 16
MIN_RATE, MIN_SHARE = 0.004, 0.3
SAMPLE = 2_000            # labelled documents a language is learned from, about
MAX_LANGUAGES = 64
MAX_GRAMS = 2_000_000     # n-grams of all languages together
BLOCK = 1 << 20           # bytes looked up at once
UNKNOWN = "und"
# Least share of a text's n-grams that its language must hold for the text to be kept. Held-out
# given documents score 0.57 or more; random letters in five words or more, 0.2 or less.
MIN_SCORE = 0.2

# ASCII letters stay, all other ASCII becomes a space, bytes of longer characters stay.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F], np.uint64)


@dataclass
class Filters:
    """Cells of the filter, one bit per language, and each language's false-positive rate."""

    langs: list[str]
    cells: np.ndarray
    false_rate: np.ndarray

    @property
    def shift(self) -> int:
        return 64 - (len(self.cells).bit_length() - 1)


def has_letter(text: str | None) -> bool:
    """Number signs such as a half or a superscript two are no letters."""
    return text is not None and any(map(str.isalpha, text))


def normal(text: str) -> bytes:
    """Letters of a text in lower case, words divided by one space and set in spaces."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(PLAIN)
                            .split()) + b" "


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Every window of ``size`` bytes as one number, the size included."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(data) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | data[i:len(data) - size + 1 + i]
    return out


def cells_of(codes: np.ndarray, probe: int, shift: int) -> np.ndarray:
    mixed = (codes ^ (codes >> np.uint64(17))) * MIX[probe]
    return (mixed >> np.uint64(shift)).astype(np.int64)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, docs) of ``labelled(lang, text)``: in how many texts an n-gram occurs."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(normal(text), np.uint8).astype(np.uint64)
                by.setdefault(lang, []).append(np.unique(np.concatenate(
                    [grams(data, n) for n in SIZES])))
            for lang, parts in by.items():
                codes, docs = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)),
                     pa.array(docs)], names=["lang", "gram", "docs"])

    rows = labelled.select("lang", "text").mapInArrow(compute, "lang string, gram long, docs long")
    return rows.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def fit(labelled: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Filters:
    """Learn filters from rows with ``text`` and ``lang``, both not null.

    Languages with more than ``sample`` rows are learned from about that many, taken by a hash of
    ``key``. The n-grams kept are few (MAX_GRAMS at most, checked) and held by every task.
    """
    known = labelled.filter("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in checked_rows(
        known.groupBy("lang").agg(F.count("*").alias("n")), MAX_LANGUAGES, "languages")}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return Filters([], np.zeros(2, np.uint8), np.zeros(0))
    spark = labelled.sparkSession
    shares = spark.createDataFrame(
        [(x, min(1 << 30, sample * (1 << 30) // totals[x])) for x in langs],
        "lang string, share long")
    drawn = known.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64(F.lit("lang"), key), F.lit(1 << 30)) < F.col("share"))
    counted = count_grams(drawn)
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("sampled"))
    rated = counted.join(F.broadcast(sizes), "lang").withColumn(
        "rate", F.col("docs") / F.col("sampled")).filter(
        (F.col("rate") >= MIN_RATE) & ((F.col("docs") > 1) | (F.col("sampled") < 50)))
    index = F.create_map(*[F.lit(v) for i, x in enumerate(langs) for v in (x, i)])
    masks = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(
        F.struct("lang", "rate")).alias("all")).select("gram", F.aggregate(
            F.filter("all", lambda e: e["rate"] >= F.col("top") * MIN_SHARE),
            F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(F.call_function(
                "shiftleft", F.lit(1).cast("long"), F.element_at(index, e["lang"])))).alias("mask"))
    rows = masks.limit(MAX_GRAMS + 1).toPandas()
    if len(rows) > MAX_GRAMS:
        raise ValueError("too many n-grams for one filter")
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                 if len(langs) <= np.dtype(t).itemsize * 8)
    cells = np.zeros(1 << max(10, (CELLS_PER_GRAM * len(rows)).bit_length()), width)
    filters = Filters(langs, cells, np.zeros(len(langs)))
    codes = rows["gram"].to_numpy(np.int64).view(np.uint64)
    bits = rows["mask"].to_numpy(np.int64).view(np.uint64).astype(width)
    for probe in range(PROBES):
        np.bitwise_or.at(cells, cells_of(codes, probe, filters.shift), bits)
    for i in range(len(langs)):
        filters.false_rate[i] = float(((cells >> width(i)) & width(1)).mean()) ** PROBES
    return filters


def count_languages(filters: Filters, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) counts of n-grams held by each filter, and all n-grams per text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    planes = filters.cells.dtype.itemsize
    found = np.zeros((planes, len(texts) * 256), np.int64)
    total = np.zeros(len(texts), np.int64)
    for n in SIZES:
        total += np.maximum(sizes - n + 1, 0)
        for at in range(0, len(data) - n + 1, BLOCK):
            codes = grams(data[at:at + BLOCK + n - 1].astype(np.uint64), n)
            mask = filters.cells[cells_of(codes, 0, filters.shift)]
            for probe in range(1, PROBES):
                mask &= filters.cells[cells_of(codes, probe, filters.shift)]
            own = owner[at:at + len(mask)]
            # Windows that reach into the next text count nowhere.
            mask = np.where(own == owner[at + n - 1:at + n - 1 + len(mask)], mask, 0)
            low = int(own[0]) if len(own) else 0
            for p in range(planes):
                part = ((mask >> filters.cells.dtype.type(8 * p)) & filters.cells.dtype.type(255))
                hist = np.bincount((own - low) * 256 + part)
                found[p, low * 256:low * 256 + len(hist)] += hist
    byte = (np.arange(256)[:, None] >> np.arange(8)) & 1
    counts = np.concatenate([f.reshape(-1, 256) @ byte for f in found], axis=1)
    return counts[:, :len(filters.langs)], total


def decide(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (share of n-grams the language holds, corrected) of each text."""
    lettered = [has_letter(t) for t in texts]
    if not filters.langs or not any(lettered):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    counts, total = count_languages(
        filters, [normal(t) if ok else b"" for t, ok in zip(texts, lettered)])
    share = counts / np.maximum(total, 1)[:, None]
    true = np.clip((share - filters.false_rate) / (1 - filters.false_rate), 0, 1)
    best = true.argmax(axis=1)
    score = np.where(lettered, true[np.arange(len(texts)), best], 0.0)
    return [filters.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    clear_names(docs, ["lang_pred", "score"])
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            names = batch.schema.names
            langs, score = decide(shared.value, batch.column(names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(langs), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(compute, schema)


def known_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` without those whose language cannot be told.

    These are nulls, texts without letters, and texts of which no language holds MIN_SCORE of
    the n-grams. Where no language could be learned, every text with a letter is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if shared.value.langs:
                langs, score = decide(shared.value, texts)
                told = [x != UNKNOWN and s >= MIN_SCORE for x, s in zip(langs, score)]
            else:
                told = [has_letter(t) for t in texts]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(compute, docs.schema)


def fold() -> Column:
    """Remainder that decides which documents are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def labelled_part(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(fold() != 2, F.lit(True)))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(labelled_part(docs).select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return identify(asked, filters).drop("text")
