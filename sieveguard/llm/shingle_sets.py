"""Classes of texts whose word shingle sets share a given part of their union.

Two texts are linked if the Jaccard similarity of their sets of shingles (runs of ``words``
lower-cased words; a shorter text is one shingle) reaches ``similarity``; classes are the
connected components.

Search. Only distinct sets are compared. Wide SimHash fingerprints of the sets are linked by
pivot tables (``simhash.py``, to its recall), with a radius that leaves room for the spread of
fingerprints at the threshold. The classes of these links are the places: only there are whole
sets brought together, and an exact comparison decides every link.

Crowded places are dealt into chunks, each with the place's smallest id as its hub, and links
that span what a chunk connects are found. Then only members that are not yet connected are
compared across chunks: the largest component of a place meets the others, not itself. So a
crowd of near copies costs rows in proportion to its size.

Texts without words have the same empty set and form one class. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveguard.llm.common import sized_batches
from sieveguard.llm.components import components
from sieveguard.llm.simhash import LANES, SEED, SIMILARITY, fp_names, set_print, wide_edges
from sieveguard.scratch import written

CHUNK = 512               # sets of a crowded place in one chunk


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, size = xxhash.xxh64_intdigest, min(words, len(tokens))
    shingles = zip(*[tokens[i:] for i in range(size)])
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64,
                                 len(tokens) - size + 1))


def with_set_prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, id, n, fp, ...) of every document: ``id`` stands for its set of ``n``
    shingles, of which the fingerprint's bits come as longs."""
    names = ["id", "n", *fp_names(LANES)]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "_text"):
            sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            prints = np.array([set_print(s) for s in sets], np.uint64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids.view(np.int64)),
                 pa.array([len(s) for s in sets], pa.int64())]
                + [pa.array(prints[:, i].copy().view(np.int64)) for i in range(LANES)],
                names=["doc_id", "text_key", *names])

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("_text"))
    schema = slim.drop("_text").withColumns({c: F.lit(0).cast("long") for c in names}).schema
    return slim.mapInArrow(compute, schema)


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of ``texts(id, text)``: the sorted hashes as bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())],
                                             names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(compute, "id long, shingles binary")


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, split: int,
                   similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different ``labels`` that span what all such links connect.

    ``split`` > 0: only pairs across the first ``split`` sets and the others.
    """
    labels = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    low, high = sizes * similarity, sizes / similarity
    out: list[tuple[int, int]] = []
    for i in range(split or len(sets) - 1):
        start = split or i + 1
        # A set too small or too large cannot share enough; a margin leaves rounding to the test.
        asked = start + np.flatnonzero(
            (labels[start:] != labels[i]) & (sizes[start:] >= low[i] - 1e-6)
            & (sizes[start:] <= high[i] + 1e-6))
        if not len(asked):
            continue
        flat, mine = np.concatenate([sets[j] for j in asked]), sets[i]
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        firsts = np.cumsum(np.concatenate([[0], sizes[asked][:-1]]))
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), firsts)
        near = shared / (sizes[i] + sizes[asked] - shared) >= similarity
        for j in asked[near].tolist():
            if labels[i] != labels[j]:
                labels[labels == labels[j]] = labels[i]
                out.append((i, j))
    return out


def verified_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) found in the units of ``rows(unit, side, id, label)``."""
    ordered = rows.join(sets, "id").select("unit", "side", "id", "label", "shingles").repartition(
        "unit").sortWithinPartitions("unit", "side", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides, ids, labels, sets = None, [], [], [], []
        edges: list[tuple[int, int]] = []

        def close() -> None:
            first = sides.count(0)
            found = spanning_links(sets, np.array(labels, np.int64),
                                   first if first < len(sides) else 0, similarity)
            edges.extend((ids[i], ids[j]) for i, j in found)

        def made() -> pa.RecordBatch:
            both = np.array(edges, np.int64).reshape(-1, 2)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()),
                                               pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != unit and len(ids) > 1:
                    close()
                if row[0] != unit:
                    unit, sides, ids, labels, sets = row[0], [], [], [], []
                sides.append(row[1])
                ids.append(row[2])
                labels.append(row[3])
                sets.append(np.frombuffer(row[4], np.uint64))
            if edges:
                yield made()
        if len(ids) > 1:
            close()
        if edges:
            yield made()

    return ordered.mapInArrow(link, "a long, b long")


def first_units(members: DataFrame, chunk: int) -> DataFrame:
    """Units of ``members(key, n, hub, id)``: whole places, or chunks with the place's hub."""
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")
    at = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(part))
    return members.select("key", "id", F.explode(at).alias("part")).select(
        F.xxhash64("key", "part").alias("unit"), F.lit(0).cast("byte").alias("side"), "id",
        F.col("id").alias("label"))


def rest_units(crowd: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """Units of what is not connected yet in crowded places ``crowd(key, id)``.

    The largest component of a place is one bucket, further ones are dealt into buckets; pairs
    of chunks within a bucket of one component are left out.
    """
    rooted = written(crowd.join(roots, crowd["id"] == roots["node"], "left").select(
        "key", "id", F.coalesce("root", "id").alias("root")), "crowd")
    tops = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("n"), F.max("c").alias("most"),
        F.max_by("root", F.struct("c", "root")).alias("top")).filter("most < n")
    spots = F.ceil((F.col("n") - F.col("most")) / F.lit(chunk))
    dealt = written(rooted.join(tops, "key").select("key", "id", "root", F.when(
        F.col("root") == F.col("top"), -1).otherwise(
        F.pmod(F.xxhash64("root", F.lit("bucket")), spots)).cast("int").alias("bucket")), "dealt")
    buckets = dealt.groupBy("key", "bucket").agg(
        F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts"),
        (F.min("root") == F.max("root")).alias("one"))
    listed = buckets.groupBy("key").agg(F.collect_list(F.struct("bucket", "parts", "one"))
                                        .alias("all"))
    met = dealt.join(buckets, ["key", "bucket"]).join(listed, "key")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    own = F.struct(F.col("bucket").alias("b"), part.alias("p"))
    other = F.flatten(F.transform(
        F.filter("all", lambda e: (e["bucket"] != F.col("bucket")) | ~e["one"]),
        lambda e: F.transform(F.sequence(F.lit(0), e["parts"] - 1),
                              lambda p: F.struct(e["bucket"].alias("b"), p.alias("p")))))
    pairs = met.select("key", "id", "root", own.alias("own"), F.explode(other).alias("other"))
    left, right = F.least("own", "other"), F.greatest("own", "other")
    return pairs.select(
        F.xxhash64("key", left, right).alias("unit"),
        F.when(F.col("own") == left, 0).otherwise(1).cast("byte").alias("side"), "id",
        F.col("root").alias("label"))


def set_classes(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY,
                chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, root) of every row of ``docs(doc_id, text)``: the root tells classes
    apart. ``docs`` is read twice."""
    marked = written(with_set_prints(docs, words), "sets")
    prints = ["n", *fp_names(LANES)]
    distinct = written(marked.groupBy("id").agg(
        *[F.min(c).alias(c) for c in [*prints, "text_key"]]), "distinct")
    alike = written(components(wide_edges(distinct.filter("n > 0").select("id", *prints),
                                          similarity)), "alike")
    places = alike.groupBy(F.col("root").alias("key")).agg(F.count("*").alias("n"))
    members = written(alike.join(places, alike["root"] == places["key"]).select(
        "key", "n", F.col("root").alias("hub"), F.col("node").alias("id")), "members")
    asked = distinct.join(members, "id", "left_semi").select("id", "text_key")
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(
        asked, "text_key").dropDuplicates(["id"])
    sets = written(sets_of(texts, words), "shingles")
    edges = written(verified_links(first_units(members, chunk), sets, similarity), "links")
    roots = written(components(edges), "roots")
    crowd = members.filter(F.col("n") > chunk).select("key", "id")
    if not crowd.isEmpty():
        more = verified_links(rest_units(crowd, roots, chunk), sets, similarity)
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
        roots = written(components(joined), "roots")
    return marked.join(roots, marked["id"] == roots["node"], "left").select(
        "doc_id", "text_key", F.coalesce("root", "id").alias("root"))
