"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document holds a benchmark item if some stretch of its words is within
``floor(rate * words of the item)`` word edits (insert, delete, replace) of the item.

Search. From a start in a document, or in an item, the CGK walk repeatedly reads the word it
stands on and moves on or stays by a random bit drawn from (step, word); near sequences
fall back into step, so the sequence of words read turns edit distance into Hamming
distance. Each repeat draws other bits and samples a few steps of the walk; words read there
are the LSH key of an item-sized window, and equal keys are candidates. Repeats are added
until the target recall is reached on items with the full number of simulated edits.

Walks start only where a window has as many of the items' word pairs as the edit bound
demands: an item of L words within k edits keeps at least ``L - 1 - 2k`` of its pairs (single
words, ``L - k``, for short items). This count never loses a match. Candidates near each other
are joined, and the exact distance of the best stretch decides.

Words are ``\\w+`` of the lower-cased text. Nulls and texts without words hold nothing and are
clean; items without words match nothing. Repeated rows and items are judged alike. With an
empty benchmark every document is clean.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard.llm.common import checked_rows, sized_batches, table
from sieveguard.llm.registry import query

RATE = 0.2
RECALL = 0.99
SAMPLED = 2               # steps of a walk in a key
REPEATS = 64              # drawn at a time
MAX_REPEATS = 2_048       # a class that needs more is reported
MAX_ITEMS = 100_000       # items every task holds
CLASS_RATIO = 1.25        # longest to shortest item of a length class
PAIR_BITS = 24
MUL = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def spread(ids: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * MUL
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def walk_keys(mixed: np.ndarray, starts: np.ndarray, salts: np.ndarray,
              steps: np.ndarray) -> np.ndarray:
    """LSH key of one repeat for the windows at ``starts``; salts[j] draws the bits of step j."""
    at, key = starts.copy(), np.zeros(len(starts), np.uint64)
    for j in range(int(steps[-1]) + 1):
        word = mixed[at]
        if j in steps:
            key = (key ^ word) * MUL
            key ^= key >> np.uint64(31)
        at += (((word ^ salts[j]) * MUL) >> np.uint64(63)).astype(np.int64)
    return key


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``; the earliest wins."""

    def ends(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        place = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else place.copy()
        for i, w in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != w))
            row = np.minimum.accumulate(new - place) + place
        return row

    row = ends(item, text, True)
    end = int(row.argmin())
    back = ends(item[::-1], text[:end][::-1], False)
    near = np.flatnonzero(back == row[end])
    return int(row[end]), end - int(near[0]) if len(near) else end, end


@dataclass
class LengthClass:
    """Items of about one length, with the window filter and the keys of all repeats."""

    items: list[int]
    window: int
    pairs: bool
    least: int
    salts: np.ndarray
    steps: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Index:
    """What a task needs to find items: vocabulary, filters, keys, and the items themselves."""

    item_ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    pair_map: np.ndarray
    classes: list[LengthClass]
    rate: float


def pair_slots(ids: np.ndarray) -> np.ndarray:
    """Place of each pair of neighbouring words in the map of pairs."""
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    return (((a << np.uint64(32) | b) * MUL) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item after random word edits; new words are none of the vocabulary."""
    out = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = 0
        elif kind == 1:
            out.insert(at, 0)
        elif out:
            del out[at]
    return np.array(out, np.int64)


def plan_repeats(items: list[np.ndarray], shortest: int, rate: float, recall: float,
                 rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(salts, steps) with as many repeats as the simulated edits need for the recall.

    Repeats are drawn until it is reached; a warning gives what MAX_REPEATS reach if they do not.
    """
    reach = 2 * shortest

    def draw() -> tuple[np.ndarray, np.ndarray]:
        return (rng.integers(0, 2 ** 64, (REPEATS, reach), dtype=np.uint64),
                np.sort(np.stack([rng.choice(reach, min(SAMPLED, reach), replace=False)
                                  for _ in range(REPEATS)]), axis=1))

    drawn = [draw()]
    tried = [items[i] for i in rng.integers(len(items), size=400)]
    pad = np.zeros(2 * reach + 2, np.int64)
    pairs = [(x, edited(x, int(rate * len(x)), rng)) for x in tried]
    sides = [[np.concatenate([p[s], pad]) for p in pairs] for s in (0, 1)]
    flat = [spread(np.concatenate(s)) for s in sides]
    starts = [np.cumsum([0] + [len(x) for x in s[:-1]]) for s in sides]
    hit, count = np.zeros(len(tried), bool), 0
    while hit.mean() < recall and count < MAX_REPEATS:
        if count == REPEATS * len(drawn):
            drawn.append(draw())
        salts, steps = (x[count % REPEATS] for x in drawn[-1])
        a, b = (walk_keys(flat[s], starts[s], salts, steps) for s in (0, 1))
        hit |= a == b
        count += 1
    if hit.mean() < recall:
        warnings.warn(f"items of {shortest} words and more: {count} repeats reach a recall of "
                      f"{hit.mean():.3f}, not {recall}", stacklevel=2)
    salts, steps = (np.concatenate(x)[:count] for x in zip(*drawn))
    return salts, steps


def build_index(items: list[tuple[object, str | None]], rate: float = RATE,
                recall: float = RECALL) -> Index:
    """Index of (item_id, text) pairs; the same items always give the same index."""
    rng = np.random.default_rng(7)
    vocabulary: dict[str, int] = {}
    ids, coded = [], []
    for item_id, text in items:
        found = words(text)
        if found:
            ids.append(item_id)
            coded.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1)
                                   for w in found], np.int64))
    pair_map = np.zeros(1 << PAIR_BITS, bool)
    for item in coded:
        pair_map[pair_slots(item)] = True
    classes, order = [], sorted(range(len(coded)), key=lambda i: (len(coded[i]), i))
    while order:
        short = len(coded[order[0]])
        members = [i for i in order if len(coded[i]) <= max(short, int(short * CLASS_RATIO))]
        order = order[len(members):]
        long = len(coded[members[-1]])
        # The bound must hold for every length of the class.
        by_pairs = min(n - 1 - 2 * int(rate * n) for n in range(short, long + 1))
        by_words = min(n - int(rate * n) for n in range(short, long + 1))
        salts, steps = plan_repeats([coded[i] for i in members], short, rate, recall, rng)
        pad = np.zeros(2 * short + 2, np.int64)
        flat = spread(np.concatenate([np.concatenate([coded[i], pad]) for i in members]))
        starts = np.cumsum([0] + [len(coded[i]) + len(pad) for i in members[:-1]])
        keys = []
        for r in range(len(salts)):
            own = walk_keys(flat, starts, salts[r], steps[r])
            by = np.argsort(own, kind="stable")
            keys.append((own[by], np.array(members)[by]))
        classes.append(LengthClass(members, long + int(rate * long), by_pairs > 0,
                                   by_pairs if by_pairs > 0 else by_words, salts, steps, keys))
    return Index(ids, coded, vocabulary, pair_map, classes, rate)


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, words) of the best stretch per text and item held."""
    if not index.items:
        return []
    get = index.vocabulary.get
    parts, gap = [], np.zeros(1, np.int64)
    for text in texts:
        tokens = words(text)
        parts += [np.fromiter(map(get, tokens, repeat(0)), np.int64, len(tokens)), gap]
    sizes = np.array([len(p) for p in parts[::2]])
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    reach = max(c.window + 2 * int(c.steps.max()) for c in index.classes) + 2
    flat = np.concatenate(parts + [np.zeros(reach, np.int64)])
    body = len(flat) - reach
    known = flat > 0
    pair = np.zeros(len(flat), bool)
    both = np.flatnonzero(known[:-1] & known[1:])
    pair[both] = index.pair_map[pair_slots_at(flat, both)]
    pair_sum = np.concatenate([[0], np.cumsum(pair)])
    word_sum = np.concatenate([[0], np.cumsum(known)])
    candidates: list[np.ndarray] = []
    mixed = None
    for cls in index.classes:
        sums = pair_sum if cls.pairs else word_sum
        width = cls.window - 1 if cls.pairs else cls.window
        many = sums[width:width + body] - sums[:body] >= cls.least
        starts = np.flatnonzero(many)
        if not len(starts):
            continue
        if mixed is None:
            mixed = spread(flat)
        for r, (keys, members) in enumerate(cls.keys):
            own = walk_keys(mixed, starts, cls.salts[r], cls.steps[r])
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            count = high - low
            if not count.any():
                continue
            rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            candidates.append(np.stack([members[np.repeat(low, count) + rank],
                                        np.repeat(starts, count)], axis=1))
    if not candidates:
        return []
    pairs = np.unique(np.concatenate(candidates), axis=0)
    return verify(index, flat, firsts, sizes, pairs)


def pair_slots_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b = flat[at].astype(np.uint64), flat[at + 1].astype(np.uint64)
    return (((a << np.uint64(32) | b) * MUL) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def verify(index: Index, flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray,
           pairs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Exact distance of candidates (item, start), those near each other taken together."""
    owner = np.searchsorted(firsts, pairs[:, 1], "right") - 1
    lengths = np.array([len(x) for x in index.items])[pairs[:, 0]]
    slack = (index.rate * lengths).astype(np.int64)
    new = np.ones(len(pairs), bool)
    new[1:] = ((pairs[1:, 0] != pairs[:-1, 0]) | (owner[1:] != owner[:-1])
               | (pairs[1:, 1] - pairs[:-1, 1] > lengths[1:]))
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(pairs)]]) - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for h, t in zip(heads, tails):
        item, doc, k = int(pairs[h, 0]), int(owner[h]), int(slack[h])
        a = max(int(firsts[doc]), int(pairs[h, 1]) - k)
        b = min(int(firsts[doc] + sizes[doc]), int(pairs[t, 1]) + int(lengths[h]) + 2 * k)
        text = flat[a:b]
        # Fewer shared words than the bound allows: no stretch can be near enough.
        if np.isin(text, index.items[item]).sum() < lengths[h] - k:
            continue
        edits, start, end = best_stretch(index.items[item], text)
        if edits <= k:
            found = (edits, a + start - int(firsts[doc]), end - start)
            best[doc, item] = min(best.get((doc, item), found), found)
    return [(doc, item, *rest) for (doc, item), rest in sorted(best.items())]


def benchmark_index(benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> Index:
    """Index of ``benchmark(item_id, text)``: MAX_ITEMS at most, checked, for every task."""
    rows = checked_rows(benchmark.select("item_id", "text"), MAX_ITEMS, "benchmark items")
    rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
    return build_index([(r["item_id"], r["text"]) for r in rows], rate, recall)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[Column],
               rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """One row per document and item it holds, with the nearest stretch of words.

    Kept columns, then ``item_id, edits, item_words, similarity, first_word, n_words``.
    """
    index = benchmark_index(benchmark, rate, recall)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    slim = docs.select(*keep, F.col("text").alias("_text"))
    fields = slim.schema.fields[:-1]
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType(fields + [
        T.StructField("item_id", kind), T.StructField("edits", T.IntegerType()),
        T.StructField("item_words", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("n_words", T.IntegerType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in sized_batches(batches, "_text", 4 << 20):
            hits = find(ix, batch.column(batch.num_columns - 1).to_pylist())
            rows = pa.array([h[0] for h in hits], pa.int64())
            lengths = np.array([len(ix.items[h[1]]) for h in hits], np.int32)
            edits = np.array([h[2] for h in hits], np.int32)
            yield pa.RecordBatch.from_arrays(
                [c.take(rows) for c in batch.columns[:-1]]
                + [pa.array([ix.item_ids[h[1]] for h in hits]).cast(arrow_type(kind)),
                   pa.array(edits), pa.array(lengths),
                   pa.array(1 - edits / np.maximum(lengths, 1), pa.float64()),
                   pa.array([h[3] for h in hits], pa.int64()),
                   pa.array([h[4] for h in hits], pa.int32())], names=schema.names)

    return slim.mapInArrow(compute, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
               recall: float = RECALL) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_index(benchmark, rate, recall))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clean = np.ones(len(texts), bool)
            clean[[h[0] for h in find(shared.value, texts)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(compute, docs.schema)


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                      [F.col("doc_id")])
