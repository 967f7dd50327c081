"""Near-duplicate operators against all pairs on small tables."""

import math
import random

import numpy as np
import pytest
import xxhash

from sieveguard.llm import embedding_dedup, shingle_sets, simhash
from sieveguard.llm.components import components
from sieveguard.scratch import written


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(80)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {got[200 + i] for i in range(80)} == {100}
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).count() == 0


def test_fingerprint_of_edge_cases():
    def one(text):
        return int(simhash.fingerprints(text)[0])

    assert one(None) == one(" \t\n") == 0
    assert one("Ab  c") == xxhash.xxh64_intdigest(b"ab c", 42)
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42)
              for s in (("a", "b", "a"), ("b", "a", "b"), ("a", "b", "a"), ("b", "a", "É"))]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert one("A b a B a É") == want


@pytest.mark.parametrize("chunk", [2048, 6])
def test_links_reach_what_all_pairs_reach(spark, chunk):
    rng = random.Random(chunk)
    prints = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    for _ in range(120):  # one crowded neighbourhood
        p = centre
        for bit in rng.sample(range(20), rng.randint(0, 6)):
            p ^= 1 << bit
        prints.append(p)
    prints = sorted(set(prints + [0, 1, (1 << 64) - 1]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = written(spark.createDataFrame([(s, s) for s in signed], "id long, fp long"), "fps")
    edges = [(r["a"], r["b"]) for r in simhash.link_edges(
        table, simhash.piece_keys(5, 3), chunk=chunk).collect()]
    place = {s: i for i, s in enumerate(signed)}
    links = [(i, j) for i in range(len(prints)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert roots(len(prints), links) == roots(
        len(prints), [(place[a], place[b]) for a, b in edges])


def test_simhash_classes_and_kept_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, "x"), (3, text.upper(), "y"), (9, text + " more", "z"), (1, None, "n"),
            (2, "", "e"), (8, "quite another text of seven words", "o"), (5, text, "x"),
            (None, "a text without an id", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (8, 8), (None, None)} == near
    kept = sorted(r["doc_id"] or 0 for r in simhash.keep_one(docs).collect())
    assert kept == [0, 1, 3, 8]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_classes_without_an_id_of_their_own_keep_a_row_each(spark):
    texts = [" ".join(f"{name}{i}" for i in range(50)) for name in "abcd"]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (None, texts[1], "x"),
            (7, texts[2], "x"), (7, texts[3], "x"), (9, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()}
    assert kept == {(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])}


def test_wide_fingerprints_find_changed_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, kin = [], []
    for d in range(40):
        text = rng.choices(words, k=300)
        rows.append((2 * d, " ".join(text), "s"))
        # Replacements in one stretch each leave about 0.87 of the five-word shingles shared.
        for at in rng.sample(range(0, 300, 30), 3):
            text[at] = "new"
        rows.append((2 * d + 1, " ".join(text), "s"))
        kin.append((2 * d, 2 * d + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert sum(b not in kept for _, b in kin) >= 39
    assert all(a in kept for a, _ in kin)


def kin_texts(rng, words, share):
    """Two texts of distinct words whose five-word shingle sets share just about ``share``."""
    # Replacing one word in the middle changes five of the ``words - 4`` shingles of each text.
    text = [f"w{rng.getrandbits(40)}" for _ in range(words)]
    total, other = words - 4, list(text)
    changes = round(total * (1 - share) / (1 + share) / 5)
    for k in range(changes):
        other[5 + k * (words - 10) // changes] = f"n{rng.getrandbits(40)}"
    changed = 5 * changes
    return " ".join(text), " ".join(other), (total - changed) / (total + changed)


@pytest.mark.parametrize("chunk", [512, 4])
def test_shared_shingles_decide_what_is_kept(spark, chunk):
    rng = random.Random(chunk)
    rows, far, near = [], [], []
    for k in range(60):
        share = 0.7 if k % 2 else 0.8 + 0.05 * rng.random()
        a, b, got = kin_texts(rng, rng.randint(280, 420), share)
        (near if got >= 0.8 else far).append(k)
        rows += [(2 * k, a), (2 * k + 1, b)]
    # One crowd, all within the threshold of a centre but mostly not of each other.
    centre = [f"c{i}" for i in range(300)]
    for k in range(30):
        text = list(centre)
        for at in rng.sample(range(10, 290, 12), 5):
            text[at] = f"x{k}_{at}"
        rows.append((1000 + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = roots(len(rows), links)
    assert len(far) >= 20 and len(near) >= 20
    found = {r["doc_id"]: r["root"] for r in shingle_sets.set_classes(docs, chunk=chunk).collect()}
    got = [found[d] for d, _ in rows]
    place = {}
    assert [place.setdefault(r, i) for i, r in enumerate(got)] == want
    if chunk == 512:
        kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
        assert kept == {rows[i][0] for i in set(want)}


@pytest.mark.parametrize("place,chunk", [(1024, 4096), (16, 12)])
def test_wide_links_reach_what_all_pairs_reach(spark, place, chunk):
    rng = random.Random(place)
    prints = [(rng.randint(4, 60), rng.getrandbits(256)) for _ in range(80)]
    for size, spread, copies in ((40, 20, 60), (52, 34, 40), (20, 45, 10)):  # crowds
        centre = rng.getrandbits(256)
        for k in range(copies):
            p = centre
            for bit in rng.sample(range(256), rng.randint(0, spread)):
                p ^= 1 << bit
            prints.append((size + k % 4, p))
    signed = [[simhash.signed(p >> 64 * i & (1 << 64) - 1) for i in range(4)] for _, p in prints]
    rows = [(i, n, *fps) for i, ((n, _), fps) in enumerate(zip(prints, signed))]
    frame = written(spark.createDataFrame(
        rows, "id long, n long, fp long, fp1 long, fp2 long, fp3 long"), "fps")
    edges = [(r["a"], r["b"]) for r in simhash.wide_edges(
        frame, 0.8, place=place, chunk=chunk).collect()]
    links = [(i, j) for i, (m, p) in enumerate(prints) for j, (n, q) in enumerate(prints[:i])
             if (p ^ q).bit_count() <= simhash.WIDE_RADIUS and min(m, n) / max(m, n) >= 0.8]
    assert len(links) > 2000
    allowed = roots(len(prints), links)
    assert all(allowed[a] == allowed[b] for a, b in edges)
    close = [(i, j) for i, j in links
             if (prints[i][1] ^ prints[j][1]).bit_count() <= 39]  # met but for 1 in 10,000
    found = roots(len(prints), edges)
    assert all(found[i] == found[j] for i, j in close)
    if place == 1024:
        assert found == allowed


def test_references_discard_only_what_is_too_far():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2 ** 64, (300, 4), dtype=np.uint64)
    fps[100:200] = fps[100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 4), dtype=np.uint64))
    sizes = np.sort(rng.integers(5, 30, 300))
    tables = np.stack([simhash.bit_distance(fps, fps[r]) for r in (0, 100, 150)])
    for split in (0, 130):
        order = np.lexsort((sizes, np.arange(300) >= split)) if split else np.arange(300)
        f, n = fps[order], sizes[order]
        links = [(i, j) for i in range(split or 300) for j in range(split or i + 1, 300)
                 if simhash.bit_distance(f[i], f[j]) <= 72 and n[i] >= 0.8 * n[j] - 1e-9
                 and n[j] >= 0.8 * n[i] - 1e-9]
        got = simhash.place_labels(f, n, split, tables[:, order], 72, 0.8)
        assert got.tolist() == roots(300, links)


def test_candidates_come_from_fingerprints_alone(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for k in range(20):
        a, b, _ = kin_texts(rng, 300, 0.85)
        rows += [(2 * k, a), (2 * k + 1, b)]
    rows += [(100 + k, " ".join(f"t{k % 5}_{i}" for i in range(8 + k // 5))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {
        *range(0, 40, 2), *range(100, 105)}
    asked, edges = [], simhash.wide_edges

    def none(distinct, *rest):
        asked.append(distinct.count())
        return edges(distinct, *rest).limit(0)

    monkeypatch.setattr(shingle_sets, "wide_edges", none)
    assert simhash.keep_one(docs).count() == 50
    assert asked == [50]


def test_keys_are_as_many_as_the_recall_asks_for():
    rng = np.random.default_rng(5)
    for bits, differing in ((3, 39 / 256), (8, 39 / 256), (8, 48 / 256)):
        count = simhash.key_count(bits, 256, differing, 0.99)
        far = rng.binomial(256, differing, 200_000) / 256
        missed = [((1 - (1 - far) ** bits) ** c).mean() for c in (count, count - 1)]
        assert missed[0] <= 0.0102 and missed[1] >= 0.0098
    assert simhash.key_count(0, 256, 39 / 256, 0.9999) == 1


@pytest.mark.parametrize("cell,fan_out", [(1024, 64), (40, 8), (10, 8)])
def test_vectors_against_all_pairs(spark, cell, fan_out):
    rng = np.random.default_rng(cell)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([rng.normal(size=(60, 8)),
                        base[rng.integers(12, size=150)] + rng.normal(size=(150, 8)) * 0.05,
                        base[rng.integers(12, size=60)] * 3.0]).astype(np.float32)
    x = np.concatenate([x, x[:5], x[70:75]])
    label = rng.integers(2, size=len(x)).tolist()
    label[-10:] = label[:5] + label[70:75]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1),
           (1003, x[0].tolist(), None), (1004, [1.0, None] + [0.0] * 6, 1), (1005, [], 1),
           (1006, [float("inf")] + [0.0] * 7, 0), (1007, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(
        frame, cell=cell, fan_out=fan_out).collect()}
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(axis=1))
    cos = d @ d.T / np.outer(norm, norm)
    near = (cos >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    want = roots(len(x), list(zip(*np.nonzero(np.tril(near)))))
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(x)))
    for i, _, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


@pytest.mark.parametrize("cell", [1024, 10])
def test_double_vectors_are_not_rounded(spark, cell):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for k in range(30):
        # Right at the threshold: the cosine is above or below it by less than a float shows.
        cos = 0.98 + (1e-10 if k % 2 else -1e-10)
        a, b = np.linalg.qr(rng.normal(size=(8, 2)))[0].T
        size = 10.0 ** (k % 3 * 100)
        rows += [(2 * k, (a * size).tolist(), k), (2 * k + 1, (
            (a * cos + b * math.sqrt(1 - cos * cos)) * size).tolist(), k)]
        want += [k % 2] * 2
    # One label with enough vectors to be split.
    wide = rng.normal(size=(40, 8)) * 1e200
    rows += [(100 + i, v.tolist(), 99) for i, v in enumerate(np.concatenate([wide, wide * 2]))]
    want += [1] * 80
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(
        frame, cell=cell, fan_out=8).collect()}
    assert [got[i] for i, _, _ in rows] == want


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(frame).count() == 0
