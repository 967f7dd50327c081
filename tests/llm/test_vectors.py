"""Near vectors: what is written on the way, crowds inside a unit, and rounds of units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveguard.llm import embedding_dedup


def frame(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(
        zip(x.astype(np.float32), labels))], "vec_id long, embedding array<float>, label int")


def near(x, labels):
    d = x.astype(np.float32).astype(np.float64)
    unit = d / np.sqrt((d * d).sum(axis=1))[:, None]
    found = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(found, False)
    return found


def counts(df):
    return [r["n_links"] for r in df.orderBy("vec_id").collect()]


def test_vectors_without_clusters_are_written_a_few_times(spark, tmp_path, monkeypatch):
    from sieveguard import scratch
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    cleaned = spark.conf.get(embedding_dedup.CLEAN_UP)
    x = np.random.default_rng(1).normal(size=(6000, 64))
    got = embedding_dedup.near_vectors(frame(spark, x, np.zeros(6000)), cell=1000)
    assert got.where("n_links > 0").count() == near(x, np.zeros(6000)).any(axis=1).sum()
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size <= 3.5 * x.astype(np.float32).nbytes
    assert spark.conf.get(embedding_dedup.CLEAN_UP) == cleaned


@pytest.mark.parametrize("edges,leaf", [(1 << 18, 1024), (50, 16)])
def test_crowds_inside_a_unit(monkeypatch, edges, leaf):
    for name, value in (("EDGES", edges), ("LEAF", leaf), ("TILE", 2 * leaf)):
        monkeypatch.setattr(embedding_dedup, name, value)
    monkeypatch.setattr(embedding_dedup.CoverTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 16))
    x = np.concatenate([base[[0]] + rng.normal(size=(400, 16)) * 1e-5,
                        base[rng.integers(4, size=300)] + rng.normal(size=(300, 16)) * 0.1,
                        rng.normal(size=(300, 16))])[rng.permutation(1000)]
    n = rng.integers(1, 4, size=1000)
    found = near(x, np.zeros(1000))
    x = x.astype(np.float32).astype(np.float64)
    for cut in (1000, 370):
        links = embedding_dedup.linked(x, cut, n, 0.98)
        own = found.copy()
        if cut < 1000:
            own[:cut, :cut] = own[cut:, cut:] = False
        assert links.count.tolist() == (own @ n).tolist()
        want = np.arange(1000)
        while True:
            least = np.where(own, want[None, :], 1000).min(axis=1)
            after = np.minimum(want, least)
            if (after == want).all():
                break
            want = after
        assert links.root.tolist() == want.tolist()


def test_rounds_and_equal_hashes_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    x = np.concatenate([base[rng.integers(6, size=150)] + rng.normal(size=(150, 8)) * 0.05,
                        rng.normal(size=(60, 8)), np.zeros((2, 8)) + [0.0, 1, 0, 0, 0, 0, 0, 0]])
    x[-1, 0] = -0.0                                            # equal to the vector before it
    labels = np.zeros(len(x), int)
    labels[-3] = 1
    want = near(x, labels).sum(axis=1).tolist()
    monkeypatch.setattr(embedding_dedup, "PAIRS_AT_ONCE", 1)
    assert counts(embedding_dedup.near_vectors(frame(spark, x, labels), cell=20, fan_out=8)) == want
    monkeypatch.setattr(embedding_dedup, "vector_key", lambda _: F.lit(7).cast("long"))
    assert counts(embedding_dedup.near_vectors(frame(spark, x, labels))) == want
