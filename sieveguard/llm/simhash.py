"""SimHash fingerprints and near-duplicate classes by pivot distance tables.

A fingerprint bit is set where over half of the shingle hashes have it. Two documents are
linked at ``radius`` or fewer differing bits; classes are the connected components.

Search. Only distinct fingerprints are compared. Bits are cut into ``PIECES`` pieces; two
fingerprints within the radius agree on at least ``PIECES - radius`` of them, so they meet in
a table keyed by some such choice of pieces (this decides where pairs can meet, and is exact).
Inside such a meeting place, a table holds the Hamming distances to PIVOTS reference
fingerprints. By the triangle inequality a pair whose distances to some pivot differ by more
than the radius is no link: rows are put in order of the first pivot distance, pairs are cut
off by the largest coordinate difference, and the full distance verifies the survivors. A
crowded place is dealt into chunks by the order of the first pivot; chunk pairs whose ranges
lie apart are never formed. Each pair of chunks returns a spanning forest of its links, not
the pairs: every link's two ends stay connected, and the number of rows stays linear.

Wider fingerprints (``LANES`` words of 64 bits, the further ones from remixed shingle hashes)
serve similarities below those that three bits stand for. They are made of shingle sets, so that
their distance stands for the part two sets share. There the meeting places are keyed by sampled
bits instead of pieces, as many and as often as the number of fingerprints and the target recall
ask for; the references are fingerprints of the table, which lie near its crowds; and of a place
only pairs are formed whose set sizes allow the similarity. ``keep_one`` takes the classes of
such links as candidates and lets an exact comparison of the sets decide (``shingle_sets.py``).

Nulls and texts without words have fingerprint 0 and are linked like any other. Repeated
rows share their fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import clear_names, sized_batches, table, unsigned_hex
from sieveguard.llm.components import components
from sieveguard.llm.registry import query
from sieveguard.scratch import written

RADIUS = 3
PIECES = 5
PIVOTS = 16
CHUNK = 2048              # fingerprints of a crowded place compared in one task at a time
SMALL = 32                # places up to this size are compared side by side
SEED = 42
LANES = 4
SIMILARITY = 0.8
# Of 256 bits: sets that share 0.8 of their union (cosine 0.89) differ in 39 of them on average,
# 6 more or less; sets of four and five shingles, where ties are frequent, in 48. The radius
# lies five deviations above the one and nearly four above the other.
WIDE_RADIUS = 72
SOUGHT = 39 / 256         # share of differing bits for which wide fingerprints reach RECALL
TINY = 5                  # sets up to this many shingles get the keys for TINY_SOUGHT
TINY_SOUGHT = 48 / 256
RECALL = 0.9999           # of pairs right at the threshold; closer ones meet more often
PLACE = 1024              # wide fingerprints of a place, at most, if bits were even
WIDE_CHUNK = 4096
BLOCK = 128               # rows of a place compared with the others at a time


def remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64-bit hashes made from given ones; lane 0 leaves them as they are."""
    if not lane:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(text: str | None, words: int = 3, lanes: int = 1) -> np.ndarray:
    """Unsigned SimHash words of one text over shingles of its lower-cased words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(lanes, np.uint64)
    digest = xxhash.xxh64_intdigest
    size = min(words, len(tokens))
    shingles = zip(*[tokens[i:] for i in range(size)])
    counts, total = np.zeros((lanes, 64), np.int64), len(tokens) - size + 1
    for start in range(0, total, 65536):
        part = np.fromiter((digest(b" ".join(s), SEED) for s in islice(shingles, 65536)), np.uint64)
        for lane in range(lanes):
            counts[lane] += bit_counts(remixed(part, lane))
    return packed(counts, total)


def set_print(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Unsigned SimHash words of a set of shingle hashes."""
    counts = np.zeros((lanes, 64), np.int64)
    for start in range(0, len(hashes), 65536):
        for lane in range(lanes):
            counts[lane] += bit_counts(remixed(hashes[start:start + 65536], lane))
    return packed(counts, len(hashes))


def packed(counts: np.ndarray, total: int) -> np.ndarray:
    """The words of which bits are set where over half of ``total`` hashes have them."""
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8")[:, 0]


def fp_names(lanes: int) -> list[str]:
    return ["fp"] + [f"fp{i}" for i in range(1, lanes)]


def with_fingerprints(docs: DataFrame, keep: list[Column], words: int = 3,
                      lanes: int = 1) -> DataFrame:
    """(kept columns, fp, fp1, ...) of every document: the fingerprint's bits as longs."""
    slim = docs.select(*keep, F.col("text").alias("_text"))
    names = slim.columns[:-1]
    schema = slim.drop("_text").withColumns(
        {n: F.lit(0).cast("long") for n in fp_names(lanes)}).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "_text"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            fps = np.array([fingerprints(t, words, lanes) for t in texts], np.uint64)
            fps = fps.reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(fps[:, i].copy()) for i in range(lanes)],
                names=names + fp_names(lanes))

    return slim.mapInArrow(compute, schema)


def pivots(lanes: int = 1, count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, drawn once and for all."""
    return np.random.default_rng(SEED).integers(0, 2 ** 64, (count, lanes), dtype=np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def piece_keys(pieces: int, radius: int) -> Column:
    """One key per choice of pieces of ``fp`` that must agree, the choice mixed into the key."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(mask)))))
    return F.array(*keys)


def key_count(bits: int, width: int, differing: float, recall: float) -> int:
    """How many keys of ``bits`` sampled bits let a pair meet with probability ``recall`` whose
    ``width`` bits differ independently, each with probability ``differing``."""
    at = np.arange(width + 1)
    logs = np.array([math.lgamma(width + 1) - math.lgamma(k + 1) - math.lgamma(width - k + 1)
                     for k in at.tolist()])
    chance = np.exp(logs + at * math.log(differing) + (width - at) * math.log(1 - differing))
    apart = 1 - (1 - at / width) ** bits
    count = 1
    while (chance * apart ** count).sum() > 1 - recall:
        count += 1
    return count


def sampled_keys(rows: int, lanes: int, place: int = PLACE) -> Column:
    """Keys of sampled bits for rows with a set size ``n``.

    A key samples as many bits as leave up to ``place`` of ``rows`` in one place; there are as
    many keys as let pairs of SOUGHT (of TINY_SOUGHT for tiny sets) meet with RECALL.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1) / place)))
    usual, most = (key_count(bits, 64 * lanes, x, RECALL) for x in (SOUGHT, TINY_SOUGHT))
    rng = np.random.default_rng(SEED)
    keys = []
    for n in range(most):
        masks = [0] * lanes
        for at in rng.choice(64 * lanes, bits, replace=False).tolist():
            masks[at // 64] |= 1 << at % 64
        keys.append(F.xxhash64(F.lit(n), *[
            F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(fp_names(lanes), masks)]))
    return F.when(F.col("n") <= TINY, F.array(*keys)).otherwise(F.array(*keys[:usual]))


def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def crowd_links(fps: np.ndarray, split: int, tables: np.ndarray, radius: int) -> list[tuple]:
    """Links of one place or chunk pair that span what its links connect, as row pairs.

    ``split`` > 0: only pairs across the first ``split`` rows and the others. Rows come in
    order of ``tables[:, 0]``, in either part.
    """
    n = len(fps)
    parent = np.arange(n)
    out = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = tables[:, 0]
    for i in range(split or n):
        low = split or i + 1
        a = low + np.searchsorted(first[low:], first[i] - radius, "left")
        b = low + np.searchsorted(first[low:], first[i] + radius, "right")
        if a >= b:
            continue
        near = np.abs(tables[a:b] - tables[i]).max(axis=1) <= radius
        close = np.flatnonzero(near) + a
        close = close[bit_distance(fps[close], fps[i]) <= radius]
        for j in close[parent[close] != parent[i]].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def dealt_units(distinct: DataFrame, keys: Column, refs: np.ndarray, names: list[str],
                radius: int, chunk: int) -> DataFrame:
    """(unit, side, id, names ...): the rows that meet, in the order of units and sides.

    A unit is a place, a chunk of a crowded place, or a pair of such chunks (the sides) whose
    ranges of distances to the first reference do not lie apart.
    """
    width = max(1, radius // 3)
    away = sum((F.bit_count(F.col(n).bitwiseXOR(F.lit(signed(int(r)))))
                for n, r in zip(fp_names(refs.shape[1]), refs[0])), F.lit(0))
    first = F.floor(away / F.lit(width)).cast("int")
    keyed = distinct.select("id", *names, first.alias("d"), F.explode(keys).alias("key"))
    # Crowded places, and how many rows they have in each range of distances from the first
    # pivot: one row per place with at most 64 * lanes + 1 entries.
    crowded = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(
        F.col("n") > chunk).select("key"), "crowded")
    hists = written(keyed.join(crowded, "key").groupBy("key", "d").agg(F.count("*").alias("n"))
                    .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("d", "n")))
                                        .alias("hist")), "hists")
    met = keyed.join(hists, "key", "left")
    # Chunks follow the pivot distance; a range with many rows takes several chunks.
    full = F.col("hist").isNotNull()
    parts = F.ceil(F.element_at("hist", F.col("d")) / F.lit(chunk))
    part = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")
    own = F.when(full, F.struct(F.col("d").alias("d"), part.alias("p"))).otherwise(
        F.struct(F.lit(-1).alias("d"), F.lit(0).alias("p")))
    other = F.when(full, F.flatten(F.transform(
        F.filter(F.map_entries("hist"),
                 lambda e: (F.abs(e["key"] - F.col("d")) - 1) * width < radius),
        lambda e: F.transform(
            F.sequence(F.lit(0), F.ceil(e["value"] / F.lit(chunk)).cast("int") - 1),
            lambda p: F.struct(e["key"].alias("d"), p.alias("p")))))).otherwise(F.array(own))
    pairs = met.select("id", *names, "d", "key", own.alias("own"), F.explode(other).alias("other"))
    left, right = F.least("own", "other"), F.greatest("own", "other")
    # Two units of one hash are compared as one, which finds no false links.
    dealt = pairs.select(F.xxhash64("key", left, right).alias("unit"), F.when(
        F.col("own") == left, 0).otherwise(1).cast("byte").alias("side"), "id", *names)
    return dealt.repartition("unit").sortWithinPartitions("unit", "side", "id")


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of batches led by ``unit``, as blocks of longs that hold complete units."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        last = held[-1]
        cut = np.flatnonzero(last[:, 0] != last[-1, 0])
        if len(cut):
            whole = np.concatenate(held[:-1] + [last[:cut[-1] + 1]])
            held = [last[cut[-1] + 1:]]
            yield whole
    if held:
        yield np.concatenate(held)


def link_edges(distinct: DataFrame, keys: Column, radius: int = RADIUS, lanes: int = 1,
               chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect what links of ``distinct(id, fp, ...)`` connect.

    ``distinct`` must be a written table: it is read several times.
    """
    refs = pivots(lanes)
    ordered = dealt_units(distinct, keys, refs, fp_names(lanes), radius, chunk)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(block: np.ndarray) -> pa.RecordBatch:
            """Links of all complete units in rows of (unit, side, id, fp, ...).

            A row linked in its unit gets an edge to the smallest id it reaches there, so that
            the same edges come out of many units and are soon merged.
            """
            new = block[1:, 0] != block[:-1, 0]
            group = np.concatenate([[0], np.cumsum(new)])
            size = np.bincount(group)
            fps = np.ascontiguousarray(block[:, 3:]).view(np.uint64)
            small = size[group] <= SMALL
            links: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
            for apart in range(1, SMALL):
                i = np.flatnonzero(small[:-apart] & (group[apart:] == group[:-apart]))
                if not len(i):
                    break
                for k in range(len(refs)):
                    gap = bit_distance(fps[i], refs[k]) - bit_distance(fps[i + apart], refs[k])
                    i = i[np.abs(gap) <= radius]
                    if k >= 3 and len(i) * 4 < len(block):
                        break
                i = i[bit_distance(fps[i], fps[i + apart]) <= radius]
                links.append(np.stack([i, i + apart], axis=1))
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            for g in np.flatnonzero(size > SMALL):
                s, e = int(starts[g]), int(starts[g] + size[g])
                tables = np.stack([bit_distance(fps[s:e], r) for r in refs], axis=1)
                side = block[s:e, 1]
                order = np.lexsort((tables[:, 0], side))
                found = crowd_links(fps[s:e][order], int((side == 0).sum()) if side[-1] else 0,
                                    tables[order], radius)
                links.append(s + order[np.array(found, np.int64).reshape(-1, 2)])
            i, j = np.concatenate(links).T
            ids = block[:, 2]
            least = ids.copy()
            while True:
                before = least.copy()
                np.minimum.at(least, i, least[j])
                np.minimum.at(least, j, least[i])
                if (before == least).all():
                    break
            some = least != ids
            edges = np.unique(np.stack([ids[some], least[some]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["a", "b"])

        for block in whole_units(batches):
            yield close(block)

    return ordered.mapInArrow(link, "a long, b long")


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, the smallest row of each row's class, after linking rows ``i`` to rows ``j``."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def place_labels(fps: np.ndarray, sizes: np.ndarray, split: int, tables: np.ndarray,
                 radius: int, similarity: float) -> np.ndarray:
    """For each row of a unit the smallest row that links lead to.

    ``tables`` holds the distances to the references, one line each. Rows come in order of
    ``sizes``; ``split`` > 0: in either part, and only pairs across the first ``split`` rows and
    the others count. Pairs whose sizes lie too far apart for ``similarity`` are left out.
    """
    label = np.arange(len(fps))
    low, high = sizes * similarity - 1e-6, sizes / similarity + 1e-6
    for s in range(0, split or len(fps), BLOCK):
        e = min(s + BLOCK, split or len(fps))
        a = split + np.searchsorted(sizes[split:], low[s], "left") if split else s
        b = split + np.searchsorted(sizes[split:], high[e - 1], "right")
        near = (sizes[a:b] >= low[s:e, None]) & (sizes[a:b] <= high[s:e, None])
        if not split:
            near &= np.arange(a, b) > np.arange(s, e)[:, None]
        near &= label[a:b] != label[s:e, None]
        if not near.any():
            continue
        for line in tables:
            mine, others = line[s:e], line[a:b]
            # A reference to which all are about as far discards nothing here.
            if max(mine.max() - others.min(), others.max() - mine.min()) > radius:
                near &= np.abs(mine[:, None] - others) <= radius
        left = np.flatnonzero(near.any(axis=0))
        far = np.zeros((e - s, len(left)), np.uint16)
        for lane in range(fps.shape[1]):
            far += np.bitwise_count(fps[s:e, lane, None] ^ fps[a + left, lane])
        i, j = np.nonzero(near[:, left] & (far <= radius))
        label = merged(label, i + s, a + left[j])
    return label


def wide_edges(distinct: DataFrame, similarity: float, radius: int = WIDE_RADIUS,
               lanes: int = LANES, place: int = PLACE, chunk: int = WIDE_CHUNK) -> DataFrame:
    """Edges (a, b) that connect what links of ``distinct(id, n, fp, ...)`` connect: wide
    fingerprints within the radius, of sets whose sizes ``n`` allow the similarity.

    ``distinct`` must be a written table: it is read several times.
    """
    names = fp_names(lanes)
    drawn = [[x % (1 << 64) for x in row] for row in
             distinct.select("id", *names).orderBy("id").limit(PIVOTS).drop("id").collect()]
    refs = np.array(drawn, np.uint64) if drawn else pivots(lanes)
    keys = sampled_keys(distinct.count(), lanes, place)
    ordered = dealt_units(distinct, keys, refs, ["n", *names], radius, chunk)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_units(batches):
            order = np.lexsort((block[:, 3], block[:, 1], block[:, 0]))
            block = block[order]
            ids, sides, sizes = block[:, 2], block[:, 1], block[:, 3]
            fps = np.ascontiguousarray(block[:, 4:]).view(np.uint64)
            tables = np.stack([bit_distance(fps, r) for r in refs])
            edges = []
            starts = np.flatnonzero(np.diff(block[:, 0], prepend=block[0, 0] - 1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
                split = int((sides[s:e] == 0).sum()) if sides[e - 1] else 0
                # Chunk pairs without a row on the first side hold no pairs.
                if sides[s]:
                    continue
                label = place_labels(fps[s:e], sizes[s:e], split, tables[:, s:e], radius,
                                     similarity)
                some = np.flatnonzero(label != np.arange(e - s))
                edges.append(np.stack([ids[s + some], ids[s + label[some]]], axis=1))
            both = np.concatenate([np.zeros((0, 2), np.int64), *edges])
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return ordered.mapInArrow(link, "a long, b long")


def classes(marked: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """(fp, root, component_id) for ``marked(doc_id, fp)``, a written table.

    ``root`` tells classes apart; ``component_id``, the smallest doc_id, is a label only: it is
    null where all doc_ids are, and classes that hold the same doc_id may share it.
    """
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
                       .withColumn("id", F.col("fp")), "prints")
    edges = link_edges(distinct.select("id", "fp"), piece_keys(pieces, radius), radius)
    roots = written(components(edges), "roots")
    rooted = distinct.join(roots, distinct["id"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of all documents with ``doc_id, text``."""
    marked = written(with_fingerprints(
        docs, [F.col("doc_id"), F.xxhash64("text").alias("text_key")], words), "simhash")
    return marked.join(classes(marked, radius), "fp")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of texts that share ``similarity`` of their shingle
    sets: its smallest doc_id; equal rows count once.

    Wide fingerprints find the candidates by pivot tables, the sets decide every link.
    """
    from sieveguard.llm.shingle_sets import set_classes  # built on this module

    clear_names(docs, ["text_key"])
    near = set_classes(docs.select("doc_id", "text"), words, similarity)
    chosen = near.groupBy("root").agg(
        F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    match = keyed["doc_id"].eqNullSafe(chosen["doc_id"]) & (
        keyed["text_key"] == chosen["text_key"])
    return keyed.join(chosen, match, "left_semi").dropDuplicates(
        ["doc_id", "text_key"]).drop("text_key")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
