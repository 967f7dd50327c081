"""Source audit, ranked search and personal data against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveguard.llm import personal_data, ranked_search, source_audit
from sieveguard.llm.labelled_spans import labelled_lines, luhn_ok
from sieveguard.llm.terms import WORDS, WORDS_AND_NUMBERS, joined_terms, term_lists
from sieveguard.scratch import scratch_path

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NUMBER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text, pattern):
    return pattern.findall((text or "").translate(ASCII_LOWER))


# --- terms ------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZ09 .é字\x00\x7f\n-", max_size=12))))
def test_terms_are_those_of_the_pattern(texts):
    for table, pattern in ((WORDS, WORD), (WORDS_AND_NUMBERS, NUMBER_WORD)):
        array = pa.array(["pad", *texts], pa.string()).slice(1)
        flat, sizes = term_lists(array, table)
        parts = np.split(np.array(flat.to_pylist(), object), np.cumsum(sizes)[:-1]) if texts else []
        assert [list(p) for p in parts] == [plain_terms(t, pattern) for t in texts]
        blocks = np.array([1 + len(t or "") % 3 for t in texts], np.int64)
        dealt = [[] for _ in texts]
        for b, joined in enumerate(joined_terms(array, table, blocks)):
            for i, text in zip(np.flatnonzero(blocks > b), joined.to_pylist(), strict=True):
                dealt[i].append([] if text == " " else text[1:].split(" "))
        for text, n, found in zip(texts, blocks, dealt):
            want = plain_terms(text, pattern)
            assert len(found) == n and sorted(sum(found, [])) == sorted(want)
            assert n > 1 or found[0] == want
            assert sum(len(set(f)) for f in found) == len(set(want))


# --- source audit -----------------------------------------------------------------------------

def plain_audit(rows, top):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(plain_terms(t, WORD), s) for t, g, s in rows if g == lang]
        df = collections.Counter(w for t, _ in own for w in set(t))
        kept = [w for w, n in df.items() if n >= 3]
        counts = {s: collections.Counter() for _, s in own}
        for t, s in own:
            counts[s].update(w for w in t if df[w] >= 3)
        whole = sum(counts.values(), collections.Counter())

        def shares(c):
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))
                    for w in kept}

        q = shares(whole)
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode())
                     for o in counts if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept
                     if counts[s][w] and p[s][w] > q[w]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, i + 1)
                        for i, (v, item) in enumerate(sorted(found)[:last])]
    return sorted(out)


AUDIT_ROWS = "text string, lang string, source string"


def audit_rows(seed=3, count=150, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}é" for a in "abcdef" for b in "xyzÄ"] + ["Shared", "common"]
    rows = [(" ".join(rng.choice(words[rng.randint(0, 20):]) for _ in range(rng.randint(0, 30))),
             rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(sources)] + [None]))
            for _ in range(count)]
    rows += [rows[0]] * 40                                   # repeated rows
    rows += [(None, "en", "s0"), ("", "xx", "a"), ("alone", "xx", "b"), ("12 3", None, None)]
    rows += [("same same", "tt", s) for s in "abc"]          # ties of all values
    rows += [("long words " * 20_000, "de", "s1")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_terms": 9, "seen": 1}])
def test_audit_equals_counts_by_hand(spark, limits, monkeypatch):
    monkeypatch.setattr(source_audit, "SEEN", limits.get("seen", 64))
    limits = {k: v for k, v in limits.items() if k != "seen"}
    for name in ("ROWS", "PAIRS") if limits else ():
        monkeypatch.setattr(source_audit, name, 7)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, AUDIT_ROWS).selectExpr("*", "1 as p", "2 as value").repartition(5)
    got = source_audit.audit(docs, top_terms=6, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 6)


def test_audit_of_nothing_and_of_rare_terms(spark):
    assert source_audit.audit(spark.createDataFrame([], AUDIT_ROWS)).count() == 0
    rows = [("one", "en", "a"), ("two", "en", "b"), (None, "en", None)]
    got = source_audit.audit(spark.createDataFrame(rows, AUDIT_ROWS))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 200)
    assert got.count() == 6                                  # pairs of value 0 alone


def test_shares_of_large_counts_are_exact():
    counts, totals = np.array([5, 10 ** 14, 10 ** 17]), np.array([11, 10 ** 15, 10 ** 18])
    want = [1 + 10 ** 9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]
    assert source_audit.share(counts, totals).tolist() == want


# --- ranked search ----------------------------------------------------------------------------

def plain_search(docs, items, top):
    terms = [(d, collections.Counter(plain_terms(t, NUMBER_WORD))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    count, words = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        asked = plain_terms(text, NUMBER_WORD)
        scores = []
        for d, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * count) // words
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))
                        * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in asked if c[w])
            if score > 0:
                scores.append((-score, -1 if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return sorted(out, key=repr)


SEARCH_DOCS, SEARCH_ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 20, "item_bytes": 40},
                                    {"shard_postings": 100, "top": 3}])
def test_search_equals_scoring_every_document(spark, limits, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_READ", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["É9", "the"]
    odds = [1 / (i + 1) for i in range(42)]
    docs = [(d, " ".join(rng.choices(words, odds, k=rng.randint(0, 40)))) for d in range(200)]
    docs += [(500 + d, docs[3][1]) for d in range(30)]       # ties
    docs += [docs[5]] * 20 + [(None, docs[7][1]), (None, None), (900, ""), (901, "w1 " * 60_000)]
    items = [(i, " ".join(rng.choices(words, k=12)) + " w1 w1") for i in range(12)]
    items += [(50, None), (51, "unknown words"), (52, docs[3][1].upper())]
    got = ranked_search.search(
        spark.createDataFrame(docs, SEARCH_DOCS).selectExpr("*", "1 as score", "2 as n").repartition(3),
        spark.createDataFrame(items, SEARCH_ITEMS).selectExpr("*", "1 as rank"), **limits)
    want = plain_search(docs, items, limits.get("top", 10))
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], SEARCH_DOCS), spark.createDataFrame(
        [(1, "a")], SEARCH_ITEMS)
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_repeated_items_are_ranked_each(spark):
    docs = spark.createDataFrame([(i, "a b " * i + "c") for i in range(4)], SEARCH_DOCS)
    twice = spark.createDataFrame([(1, "a"), (1, "c")], SEARCH_ITEMS)
    got = ranked_search.search(docs, twice).collect()
    assert collections.Counter(r["rank"] for r in got)[1] == 2


def test_reading_stops_early_where_few_can_win():
    rng = np.random.default_rng(1)
    n = 4_000
    codes = [np.array([0, 1] if d >= 20 else [0, 1, 2], np.int64) for d in range(n)]
    sizes = np.array([len(c) for c in codes])
    lists = ranked_search.ImpactLists(
        rng.integers(80, 120, n), sizes, np.concatenate(codes),
        np.concatenate([rng.integers(1, 3, len(c)) for c in codes]), np.array([3, 2, 9_000]))
    docs, scores = lists.best(np.array([0, 1, 2]), np.ones(3, np.int64), 10)
    assert len(docs) == 10 and (docs < 20).all() and (np.diff(scores) <= 0).all()


# --- personal data ----------------------------------------------------------------------------

def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m.group())
        if 16 <= len(number) <= 19 and luhn_ok(number):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1204.@+-( )é%", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert personal_data.base_spans(text) == plain_base(text)


def test_base_spans_of_labelled_and_long_texts():
    for text, _ in labelled_lines(400, 5):
        assert personal_data.base_spans(text) == plain_base(text)
    for bad in ("a" * 300_000, "1" * 300_000, "+1 " * 100_000, "a@" * 100_000, "1." * 100_000):
        personal_data.base_spans(bad)
        personal_data.all_spans(bad[:20_000], personal_data.train())
    text = "x " * 200_000 + "call (212) 555-0147 or mail anna@example.org"
    assert [s[0] for s in personal_data.all_spans(text, personal_data.train())] == ["email", "phone"]


def test_best_segments_beat_every_other_segmentation():
    rng = np.random.default_rng(2)
    field = personal_data.Field(rng.normal(0, 2, (4, len(personal_data.NAMES))),
                                rng.normal(0, 1, (5, 4)))
    tried = 0
    for text, _ in labelled_lines(120, 6):
        for run in personal_data.stretches(personal_data.candidates(text)):
            if len(run) > 12:
                continue
            tried += 1

            def total(chosen):
                before, score = 0, 0.0
                for c in chosen:
                    score += field.score(c) - 1.0 + field.follows[before, c.kind]
                    before = c.kind + 1
                return score

            legal = [s for n in range(len(run) + 1) for s in itertools.combinations(run, n)
                     if all(x.end <= y.start for x, y in zip(s, s[1:]))]
            best = personal_data.best_segments(field, run, 1.0)
            assert total(best) == pytest.approx(max(map(total, legal)))
    assert tried > 50


def test_training_climbs_the_likelihood_of_all_segmentations():
    """The gradient's zero: expected features equal the labelled ones, up to the penalty."""
    field = personal_data.train(300, 3)
    gap = np.zeros_like(field.weights)
    for text, spans in labelled_lines(300, 3):
        for run in personal_data.stretches(personal_data.candidates(text)):
            if len(run) > 12:
                continue
            legal = [s for n in range(len(run) + 1) for s in itertools.combinations(run, n)
                     if all(x.end <= y.start for x, y in zip(s, s[1:]))]
            scores = []
            for s in legal:
                before, score = 0, 0.0
                for c in s:
                    score += field.score(c) + field.follows[before, c.kind]
                    before = c.kind + 1
                scores.append(score)
            odds = np.exp(np.array(scores) - np.logaddexp.reduce(scores))
            for s, p in zip(legal, odds):
                for c in s:
                    gap[c.kind, list(c.features)] -= p
            for c in run:
                if (personal_data.KINDS[c.kind], c.start, c.end) in set(spans):
                    gap[c.kind, list(c.features)] += 1
    assert np.abs(gap - personal_data.PENALTY * field.weights).mean() < 1.5


def test_held_out_lines():
    field = personal_data.train()
    hit = missed = wrong = 0
    for text, spans in labelled_lines(1_000, 77):
        got = {s[:3] for s in personal_data.all_spans(text, field)}
        base = set(personal_data.base_spans(text))
        hit += len(got & set(spans))
        missed += len(set(spans) - got)
        wrong += len(got - set(spans) - base)
    assert hit / (hit + missed) >= 0.97 and wrong / hit <= 0.03


def test_query_derives_counts_and_digest(spark):
    rows = [(1, "mail anna@example.org, ip 10.1.2.3, +1 (212) 555-0147"), (2, None), (3, ""),
            (4, "card 4111 1111 1111 1111 and (212) 555-0147"), (4, "é a@b.c"), (None, "ip 1.2.3.999"),
            (5, "order 2024-05-06 at noon, 1,234,567.89, version 1.2.3")]
    folder = scratch_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = personal_data.op11_personal_data(spark, folder).collect()
    assert len(got) == len(rows)
    want = []
    for d, text in rows:
        base = [":".join(map(str, s)) for s in plain_base(text or "")]
        counts = collections.Counter(s.split(":")[0] for s in base)
        want.append((d, *[counts[k] for k in personal_data.KINDS],
                     hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    added = {r["doc_id"]: (r["spans"], r["n_added"]) for r in got if r["n_added"]}
    assert added == {4: ("card:5:24,phone:29:43", 1)}


def test_spans_refuse_a_clashing_column_and_carry_the_rest(spark):
    docs = spark.createDataFrame([(1, "a@b.org", "x")], "doc_id long, text string, kind string")
    row = personal_data.find_spans(docs).first()
    assert row["kind"] == "x" and row["spans"][0]["text"] == "a@b.org"
    with pytest.raises(ValueError):
        personal_data.find_spans(docs.withColumnRenamed("kind", "spans"))
    assert personal_data.find_spans(docs.limit(0)).count() == 0
