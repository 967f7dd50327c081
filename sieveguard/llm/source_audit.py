"""How far the sources of a language differ in their terms, from exact counts.

One CountVectorizer per language, with an integer minDF and the largest vocabulary size, turns
every document into an exact sparse vector. The vectors of a (language, source) group are summed
as they come, index by index, so no dense row of a vocabulary is held. Smoothed shares of all
groups are then compared in pairs of sources from the terms that both hold; what one of them
lacks has one share for all its terms, so it enters by counts of equal shares.

Vocabularies are dealt into blocks of about BLOCK_TERMS distinct terms by a hash, and each block
has a vectorizer of its own: sums over blocks are the sums over the whole vocabulary, and the
driver holds one block's terms at a time.

Nulls in text, language and source count as ''. Groups without terms, and languages in which no
term is in enough documents, have their pairs (value 0 where no term is kept) and no terms.
Repeated rows are documents of their own. Ties of value go by the item's UTF-8 bytes. Long texts
are read whole. Other columns are not looked at, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import sized_batches, table
from sieveguard.llm.registry import query
from sieveguard.llm.terms import WORDS, joined_terms, term_hashes, term_lists
from sieveguard.scratch import scratch_path, written

MIN_DOCS = 3
TOP_TERMS = 200
EVERY_TERM = 2 ** 31 - 1
SCALE = 1_000_000_000     # shares are counted in parts of this
BLOCK_TERMS = 1 << 19
SEEN = 64                 # one in so many terms tells how many there are
BATCH_BYTES = 4 << 20     # text looked at at once
ROWS = 1 << 16            # counts looked at at once, about
PAIRS = 1 << 20           # pairs of shares compared at once
# In every document of a language, and never a term: a vectorizer then always has a vocabulary.
FILLER = ""


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])


def lang_key(lang: Column) -> Column:
    """A language as the name of a folder."""
    return F.concat(F.lit("l"), F.sha2(lang.cast("binary"), 256))


def term_blocks(rows: DataFrame, block_terms: int) -> dict[str, int]:
    """Blocks of each language whose distinct terms (estimated from one in SEEN of them, chosen by
    a hash) need more than one."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            flat, sizes = term_lists(batch.column(1), WORDS)
            langs = batch.column(0).dictionary_encode()
            seen = np.flatnonzero(term_hashes(flat) % SEEN == 0)
            owner = np.repeat(langs.indices.to_numpy(), sizes)[seen]
            terms = flat.take(pa.array(seen))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = terms.filter(pa.array(owner == i)).unique().cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), own], names=["lang", "term"])

    seen = rows.select("lang", "text").mapInArrow(compute, "lang string, term string")
    counted = seen.groupBy("lang").agg((SEEN * F.count_distinct("term")).alias("n"))
    return {r["lang"]: -(-r["n"] // block_terms) for r in counted.where(
        F.col("n") > block_terms).toLocalIterator()}


def write_terms(rows: DataFrame, path: str, blocks: dict[str, int]) -> None:
    """Terms of every document, a row for each, in folders by language: a column for each block of
    terms, null where the language has fewer.

    A column is one string with each term after a space: cut at spaces, it starts with the FILLER.
    """
    columns = [f"terms_{b}" for b in range(max(blocks.values(), default=1))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", BATCH_BYTES):
            parts = np.array([blocks.get(x, 1) for x in batch.column(0).to_pylist()], np.int64)
            found = joined_terms(batch.column(2), WORDS, parts)
            dealt = []
            for b in range(len(columns)):
                place = np.cumsum(parts > b) - 1
                dealt.append(pa.nulls(len(parts), pa.string()) if b >= len(found) else
                             found[b].take(pa.array(place, mask=parts <= b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *dealt],
                                             names=["lang", "source", *columns])

    layout = ", ".join(f"{c} string" for c in ["lang", "source", *columns])
    out = rows.select("lang", "source", "text").mapInArrow(compute, layout)
    (out.select(lang_key(F.col("lang")).alias("lang_key"), "source", *columns)
     .write.partitionBy("lang_key").parquet(path))


def group_sums(vectors: DataFrame) -> DataFrame:
    """(source, index, count): sums of ``vectors(source, vector)``, without their zeros."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sources = batch.column(0).dictionary_encode()
            vector = batch.column(1)
            indices, values = vector.field("indices"), vector.field("values")
            sizes = indices.value_lengths().to_numpy()
            owner = np.repeat(sources.indices.to_numpy().astype(np.int64), sizes)
            keys = (owner << 32) | indices.flatten().to_numpy()
            order = np.argsort(keys)
            keys, amounts = keys[order], values.flatten().to_numpy()[order].astype(np.int64)
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            if not len(first):
                continue
            keys = keys[first]
            yield pa.RecordBatch.from_arrays(
                [sources.dictionary.take(pa.array(keys >> 32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(np.add.reduceat(amounts, first))], names=["source", "index", "count"])

    parts = vectors.mapInArrow(compute, "source string, index int, count long")
    return parts.groupBy("source", "index").agg(F.sum("count").alias("count"))


COUNTS = "lang string, source string, term string, count long"


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS
                ) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count) of the terms in at least ``min_docs`` documents of the
    language, counts of 0 left out, and (lang, v), the number of such terms."""
    spark, rows = docs.sparkSession, plain(docs)
    blocks = term_blocks(rows, block_terms)
    terms = scratch_path(spark, "audit_terms")
    write_terms(rows, terms, blocks)
    sums, kept = scratch_path(spark, "audit_sums"), []
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_docs).select("lang", lang_key(F.col("lang")).alias("key"))
    for lang, key in langs.toLocalIterator():
        size = 0
        for block in range(blocks.get(lang, 1)):
            own = spark.read.schema(f"source string, terms_{block} string").parquet(
                f"{terms}/lang_key={key}").select(
                "source", F.split(f"terms_{block}", " ", -1).alias("terms"))
            # Which terms are kept depends on documents alone, so each term is shown once here.
            model = CountVectorizer(
                inputCol="terms", outputCol="vector", minDF=float(min_docs),
                vocabSize=EVERY_TERM).fit(own.select(F.array_distinct("terms").alias("terms")))
            kept_terms = pa.array(model.vocabulary, pa.string())
            size += len(kept_terms) - 1
            words = spark.createDataFrame(pa.table({
                "index": pa.array(np.arange(len(kept_terms), dtype=np.int32)),
                "term": kept_terms})).where(F.col("term") != FILLER)
            counted = group_sums(model.transform(own).select("source", "vector"))
            counted.join(words, "index").select(
                F.lit(lang).alias("lang"), "source", "term", "count").write.mode(
                "append").parquet(sums)
        kept.append((lang, size))
    counts = spark.read.schema(COUNTS).parquet(sums) if kept else spark.createDataFrame([], COUNTS)
    return counts, spark.createDataFrame(kept, "lang string, v long")


def group_sizes(docs: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, number, n, v, whole) of every group: its occurrences of kept terms, the
    terms of its language, and the language's occurrences."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                           for c in ("lang", "source")]).groupBy("lang", "source").agg(
        F.count("*").alias("docs"))
    n = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    own = Window.partitionBy("lang")
    return groups.join(n, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", (F.row_number().over(own.orderBy("source")) - 1).alias("number"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
        F.coalesce(F.sum("n").over(own), F.lit(0)).alias("whole"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if len(count) and int(count.max()) > 9_000_000_000:
        return (1 + SCALE * (count.astype(object) + 1) // total.astype(object)).astype(np.int64)
    return 1 + SCALE * (count + 1) // total


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (lang, term) in tables of about ROWS that do not cut a term."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table_ = pa.Table.from_batches(held).combine_chunks()
        last = _term_starts(table_)[-1]
        if last:
            yield table_.slice(0, last)
        held = table_.slice(last).to_batches()
        rows = rows - last
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _term_starts(rows: pa.Table) -> np.ndarray:
    changed = np.ones(len(rows), bool)
    if len(rows) > 1:
        changed[1:] = False
        for name in ("lang", "term"):
            column = rows.column(name).combine_chunks()
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)
                                        ).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _summed(langs: list, keys: list[np.ndarray], values: list[np.ndarray]) -> pd.DataFrame:
    frame = pd.DataFrame({f"k{i}": k for i, k in enumerate(keys)}
                         | {f"v{i}": v for i, v in enumerate(values)})
    out = frame.groupby([f"k{i}" for i in range(len(keys))], as_index=False, sort=False).sum()
    return out.assign(k0=[langs[i] for i in out["k0"]])


def compared(counts: DataFrame, sizes: DataFrame, top_terms: int) -> DataFrame:
    """One pass over all terms: rows (lang, part, g, h, term, a, b).

    Part ``pair``: over terms that g and h both hold, what the gap of their shares differs from
    what their own terms stand for, as a * 2^32 + b. Part ``own``: b terms of g have the share a.
    Part ``term``: a term with a larger share in g than in the language, and their gap a; a task
    hands on the first ``top_terms`` of each g in every table of rows.
    """
    rows = counts.join(sizes, ["lang", "source"]).select(
        "lang", "term", F.col("number").cast("long").alias("g"), "count",
        (F.col("n") + F.col("v")).alias("n"), (F.col("whole") + F.col("v")).alias("whole"))
    rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term")

    def batch_of(part: str, lang: list, g, h=None, term=None, a=None, b=None) -> pa.RecordBatch:
        n = len(lang)
        blank = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array([part] * n, pa.string()), pa.array(g),
             pa.array(blank if h is None else h),
             pa.nulls(n, pa.string()) if term is None else term.cast(pa.string()),
             pa.array(a), pa.array(blank if b is None else b)],
            names=["lang", "part", "g", "h", "term", "a", "b"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_terms(batches):
            starts = _term_starts(part)
            size = np.diff(np.append(starts, len(part)))
            coded = part.column("lang").combine_chunks().dictionary_encode()
            names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            g, count, n, whole = (part.column(c).to_numpy() for c in ("g", "count", "n", "whole"))
            p, absent = share(count, n), share(np.zeros_like(n), n)
            q = np.repeat(share(np.add.reduceat(count, starts), whole[starts]), size)

            raised = np.flatnonzero(p > q)
            value = gap(p[raised], q[raised])
            # Rows are in the order of the terms, so places decide ties.
            order = np.lexsort((raised, -value, g[raised], lang[raised]))
            group = lang[raised][order] << 32 | g[raised][order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            best = order[nth < top_terms]
            at = raised[best]
            yield batch_of("term", [names[i] for i in lang[at]], g[at],
                           term=part.column("term").combine_chunks().take(pa.array(at)),
                           a=value[best])

            own = _summed(names, [lang, g, p], [np.ones(len(p), np.int64)])
            yield batch_of("own", own["k0"].tolist(), own["k1"].to_numpy(), a=own["k2"].to_numpy(),
                           b=own["v0"].to_numpy())

            start, size = np.repeat(starts, size), np.repeat(size, size)
            ends, low = np.cumsum(size), 0
            while low < len(ends):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
                k = size[low:high]
                x = np.repeat(np.arange(low, high), k)
                y = start[x] + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                x, y = x[x != y], y[x != y]
                value = (gap(p[x], p[y]) - gap(p[x], absent[y]) - gap(absent[x], p[y])
                         + gap(absent[x], absent[y]))
                both = _summed(names, [lang[x], g[x], g[y]], [value >> 32, value & 0xFFFFFFFF])
                yield batch_of("pair", both["k0"].tolist(), both["k1"].to_numpy(),
                               both["k2"].to_numpy(), a=both["v0"].to_numpy(),
                               b=both["v1"].to_numpy())
                low = high

    return rows.mapInArrow(compute, "lang string, part string, g long, h long, term string,"
                                    " a long, b long")


def source_pairs(sizes: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    wide = "decimal(38,0)"
    absent = F.when(F.col("v") > 0, F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) div cast(n + v as decimal(20,0)))"))
    g = sizes.select("lang", F.col("number").alias("g"), "source", absent.alias("g0"), "v")
    h = sizes.select("lang", F.col("number").alias("h"), F.col("source").alias("item"),
                     absent.alias("h0"))

    def squared(p: str, q: str) -> Column:
        return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}").cast(wide)

    both_absent = F.coalesce(squared("g0", "h0"), F.lit(0).cast(wide))
    base = g.join(h, "lang").where("g <> h").select(
        "lang", "g", "h", (F.col("v").cast(wide) * both_absent).cast(wide).alias("value"))
    own = parts.where("part = 'own'").groupBy("lang", "g", F.col("a").alias("p")).agg(
        F.sum("b").cast(wide).alias("k"))
    one = own.join(g.drop("source", "v"), ["lang", "g"]).join(h.drop("item"), "lang").where(
        "g <> h").select("lang", "g", "h", (F.col("k") * (squared("p", "h0") - both_absent))
                         .cast(wide).alias("value"))
    two = own.withColumnRenamed("g", "h").join(h.drop("item"), ["lang", "h"]).join(
        g.drop("source", "v"), "lang").where("g <> h").select(
        "lang", "g", "h", (F.col("k") * (squared("g0", "p") - both_absent))
        .cast(wide).alias("value"))
    both = parts.where("part = 'pair'").select(
        "lang", F.col("g").cast("int").alias("g"), F.col("h").cast("int").alias("h"),
        (F.col("a").cast(wide) * F.lit(1 << 32) + F.col("b")).cast(wide).alias("value"))
    total = base.union(one).union(two).union(both).groupBy("lang", "g", "h").agg(
        F.sum("value").cast("long").alias("value"))
    return total.join(g.select("lang", "g", "source"), ["lang", "g"]).join(
        h.select("lang", "h", "item"), ["lang", "h"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
          block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language. Part ``term``: the ``top_terms`` terms by
    which the source stands out in its language.
    """
    counts, kept = count_terms(docs, min_docs, block_terms)
    sizes = written(group_sizes(docs, counts, kept), "audit_sizes")
    parts = written(compared(counts, sizes, top_terms), "audit_parts")
    terms = parts.where("part = 'term'").join(
        sizes.select("lang", F.col("number").cast("long").alias("g"), "source"), ["lang", "g"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = []
    for part, rows in (("pair", source_pairs(sizes, parts)), ("term", terms.select(
            "lang", "source", F.col("term").alias("item"), F.col("a").alias("value")))):
        ranked = rows.withColumn("rank", F.row_number().over(order))
        if part == "term":
            ranked = ranked.where(F.col("rank") <= top_terms)
        out.append(ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                                 "rank"))
    return out[0].union(out[1])


AUDIT_SQL = r"""
with d as (
  select row_number() over () as row_id, coalesce(text, '') as text, coalesce(lang, '') as lang,
    coalesce(source, '') as source from documents),
t as (
  select row_id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by all having count(distinct row_id) >= 3),
g as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from t group by all),
c as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as c from g join k using (lang)
  left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
s as (
  select lang, source, term, c, 1 + (1000000000::hugeint * (c + 1))
    // (sum(c) over (partition by lang, source) + count(*) over (partition by lang, source)) as p
  from c),
a as (select lang, term, sum(c) as c from c group by all),
w as (
  select lang, term, 1 + (1000000000::hugeint * (c + 1))
    // (sum(c) over (partition by lang) + count(*) over (partition by lang)) as q from a),
pairs as (
  select x.lang, x.source, y.source as item, (select coalesce(sum((l.p - r.p) * (l.p - r.p) // r.p), 0)
    from s l join s r on l.lang = r.lang and l.term = r.term
    where l.lang = x.lang and l.source = x.source and r.source = y.source) as value
  from g x join g y on x.lang = y.lang and x.source <> y.source),
terms as (
  select s.lang, s.source, s.term as item, (p - q) * (p - q) // q as value
  from s join w on s.lang = w.lang and s.term = w.term where c > 0 and p > q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank
from pairs
union all
select lang, source, 'term', item, cast(value as bigint),
  cast(row_number() over (partition by lang, source order by value desc, item) as int) as r
from terms qualify r <= 200"""


@query("op13_source_audit", AUDIT_SQL)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
