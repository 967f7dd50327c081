"""Ranked lexical search: no-random-access reads of impact-sorted lists, per shard of documents.

A posting's impact is its whole part of a score, so a term's list sorted by falling impact can be
read from the front. Every document met has a lower bound (the impacts read so far) and an upper
bound (plus, for each term not met in it, the impact at which that term's list stands). Reading
goes on, all lists in step, until no document outside can reach the last place, and then, for
those that still can, until every interval has closed: membership, ties and scores are then final.

Documents are dealt into shards of SHARD_DOCS documents and SHARD_POSTINGS postings at most, on
average, by a hash of a number drawn once; a shard hands on its best documents of each item, and
the best of all shards are the result, since weights and lengths are those of the whole corpus.
Items are taken in blocks of ITEM_BYTES of text (an item is never cut), and each block reads
the documents once: tasks and driver hold one block's terms.

Null or empty texts hold no term; such documents count nowhere and such items find nothing.
Repeated documents are ranked each; equal scores go by doc_id, null first, and rows alike in both
are interchangeable. Repeated items are ranked each. Long texts are read whole. Other columns are
not looked at, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import sized_batches, table
from sieveguard.llm.registry import query
from sieveguard.llm.terms import WORDS_AND_NUMBERS, term_lists
from sieveguard.scratch import written

TOP = 10
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 1 << 21
ITEM_BYTES = 4 << 20
FIRST_READ = 64           # postings read from every list at first; doubled from then on


@dataclass
class Asked:
    """A block of items: their ids, and for each the numbers of its terms and how often it has
    them. ``terms`` are the distinct terms of the block."""

    ids: list
    terms: pa.Array
    wanted: list[tuple[np.ndarray, np.ndarray]]


def asked_blocks(items: DataFrame, limit: int) -> Iterator[Asked]:
    """Blocks of ``items(item_id, text)``, fetched one after the other."""
    ids, texts, held = [], [], 0
    for item, text in items.toLocalIterator():
        size = len((text or "").encode())
        if ids and held + size > limit:
            yield _asked(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += size
    if ids:
        yield _asked(ids, texts)


def _asked(ids: list, texts: list[str | None]) -> Asked:
    flat, sizes = term_lists(pa.array(texts, pa.string()), WORDS_AND_NUMBERS)
    coded = flat.dictionary_encode()
    parts = np.split(coded.indices.to_numpy(), np.cumsum(sizes)[:-1])
    return Asked(ids, coded.dictionary.cast(pa.string()),
                 [np.unique(p, return_counts=True) for p in parts])


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, place, n, codes, tfs) of ``docs(doc_id, text)`` with at least one term.

    ``n`` counts all terms; ``codes`` are the numbers of the asked ones it holds, ``tfs`` how
    often. ``place`` tells rows apart.
    """
    layout = (docs.select("doc_id").withColumns({
        "place": F.lit(0).cast("long"), "n": F.lit(0).cast("long"),
        "codes": F.array().cast("array<int>"), "tfs": F.array().cast("array<int>")})).schema
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.cast(pa.large_string())
        place = TaskContext.get().partitionId() << 40
        for batch in sized_batches(batches, "text", 8 << 20):
            flat, sizes = term_lists(batch.column(1), WORDS_AND_NUMBERS)
            codes = pc.index_in(flat, value_set=asked).fill_null(-1).to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keys, tfs = np.unique((owner * len(asked) + codes)[codes >= 0], return_counts=True)
            held = np.bincount(keys // max(len(asked), 1), minlength=len(sizes))
            ends = pa.array(np.append(0, np.cumsum(held)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place + np.arange(len(sizes))), pa.array(sizes),
                 pa.ListArray.from_arrays(ends, pa.array(
                     (keys % max(len(asked), 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))],
                names=["doc_id", "place", "n", "codes", "tfs"])
            place += len(sizes)
            yield out.filter(pa.array(sizes > 0))

    return docs.select("doc_id", "text").mapInArrow(compute, layout)


def weights(rows: DataFrame, count: int, asked: int) -> np.ndarray:
    """Weight of every asked term; 0 where no document holds it."""
    weight = F.floor(1000 * F.ln(F.expr(f"(2 * {count} + 2) / (2 * df + 1)"))).cast("long")
    found = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(
        F.count("*").alias("df")).select("code", weight.alias("w"))
    out = np.zeros(asked, np.int64)
    for code, w in found.toLocalIterator():     # at most the terms of one block
        out[code] = w
    return out


class ImpactLists:
    """Lists of one shard: for every term, documents by falling impact."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, codes: np.ndarray, tfs: np.ndarray,
                 weight: np.ndarray) -> None:
        docs = np.repeat(np.arange(len(m)), sizes)
        tfs = tfs.astype(np.int64)
        impacts = weight[codes] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
        order = np.lexsort((-impacts, codes))
        self.docs, self.impacts = docs[order], impacts[order]
        self.bounds = np.searchsorted(codes[order], np.arange(len(weight) + 1))
        self.size = len(m)
        self.read = 0         # postings read so far

    def best(self, wanted: np.ndarray, times: np.ndarray, top: int
             ) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` documents with the highest score above 0, and their scores.

        Equal scores go by the documents' order.
        """
        at, ends = self.bounds[wanted].copy(), self.bounds[wanted + 1]
        lower = np.zeros(self.size, np.int64)
        seen = np.zeros((len(wanted), self.size), bool)
        slots, owners = None, np.arange(self.size)
        step = FIRST_READ
        while True:
            for t in np.flatnonzero(at < ends):
                high = min(at[t] + step, ends[t])
                docs, gains = self.docs[at[t]:high], self.impacts[at[t]:high] * times[t]
                self.read += len(docs)
                at[t] = high
                if slots is not None:
                    docs = slots[docs]
                    docs, gains = docs[docs >= 0], gains[docs >= 0]
                lower[docs] += gains
                seen[t, docs] = True
            step *= 2
            ahead = np.zeros(len(wanted), np.int64)
            left = np.flatnonzero(at < ends)
            ahead[left] = self.impacts[at[left]] * times[left]
            last = np.partition(lower, -top)[-top] if len(lower) >= top else 0
            bar = max(int(last), 1)
            if ahead.sum() >= bar and slots is None:
                continue      # a document not met yet may still belong
            upper = lower + ahead.sum() - ahead @ seen
            able = upper >= bar
            if slots is None:
                slots = np.full(self.size, -1)
            else:
                slots[owners[~able]] = -1
            owners, lower, seen = owners[able], lower[able], seen[:, able]
            slots[owners] = np.arange(len(owners))
            if (upper[able] == lower).all():
                break
        order = np.lexsort((owners, -lower))[:top]
        return owners[order], lower[order]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES,
           shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs(doc_id, text)`` for each of
    ``items(item_id, text)``, all with a score above 0."""
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    doc_type, item_type = (df.schema[0].dataType.simpleString() for df in (docs, items))
    layout = f"item_id {item_type}, rank int, doc_id {doc_type}, score long"
    parts = [_search_block(docs, asked, item_type, doc_type, top, shard_docs, shard_postings)
             for asked in asked_blocks(items, item_bytes)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], layout)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _search_block(docs: DataFrame, asked: Asked, item_type: str, doc_type: str, top: int,
                  shard_docs: int, shard_postings: int) -> DataFrame | None:
    spark = docs.sparkSession
    rows = written(postings(docs, asked.terms), "postings")
    count, words, held = rows.agg(F.count("*"), F.sum("n"), F.sum(F.size("codes"))).first()
    if not held:
        return None
    weight = spark.sparkContext.broadcast(weights(rows, count, len(asked.terms)))
    wanted = spark.sparkContext.broadcast(asked.wanted)
    shards = max(1, -(-count // shard_docs), -(-held // shard_postings))
    placed = rows.where(F.size("codes") > 0).select(
        F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"), "doc_id",
        F.expr(f"100 - 75 + (75 * n * {count}L) div {words}L").alias("m"), "codes", "tfs")

    def compute(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, [("doc_id", "ascending")],
                                           null_placement="at_start")).combine_chunks()
        codes, tfs = (shard.column(c).combine_chunks() for c in ("codes", "tfs"))
        lists = ImpactLists(shard.column("m").to_numpy(), codes.value_lengths().to_numpy(),
                            codes.flatten().to_numpy(), tfs.flatten().to_numpy(), weight.value)
        numbers, docs_found, scores = [], [], []
        for number, (terms, times) in enumerate(wanted.value):
            found, score = lists.best(terms, times, top)
            numbers.append(np.full(len(found), number, np.int32))
            docs_found.append(found)
            scores.append(score)
        return pa.table({"number": np.concatenate(numbers),
                         "doc_id": shard.column("doc_id").take(pa.array(
                             np.concatenate(docs_found).astype(np.int64))),
                         "score": np.concatenate(scores).astype(np.int64)})

    best = placed.groupBy("shard").applyInArrow(
        compute, f"number int, doc_id {doc_type}, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"number int, item_id {item_type}")
    return best.withColumn("rank", rank).where(F.col("rank") <= top).join(
        names, "number").select("item_id", "rank", "doc_id", "score")


TERM_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SEARCH_SQL = f"""
with t as (
  select r, doc_id, unnest({TERM_SQL}) as term
  from (select row_number() over () as r, doc_id, text from documents)),
n as (select r, doc_id, count(*) as n from t group by all),
g as (select count(*) as docs, cast(sum(n) as bigint) as words from n),
p as (select r, term, count(*) as tf from t group by all),
f as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from p, g group by term, docs),
q as (select item_id, unnest({TERM_SQL}) as term from benchmark),
s as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf)
    // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) as bigint) as score
  from q join p using (term) join f using (term) join n using (r), g group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int)
  as rank, doc_id, score
from s where score > 0 qualify rank <= 10"""


@query("op12_ranked_search", SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
