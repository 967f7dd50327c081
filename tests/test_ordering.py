import random

import pytest
from pyspark.sql import functions as F

from sieveguard.operators import ordering as O


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, x double, id long, name string")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        # a third of all rows share one value
        x = 7.0 if i % 3 == 0 else float(rng.randrange(400))
        rows.append((None if i % 11 == 0 else i % 5, x, i, f"n{rng.randrange(10**6)}-{i}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("order,key", [
    (["x", "id"], lambda r: (r[1], r[2])),
    (["-x", "id"], lambda r: (-r[1], r[2])),
    (["x", "-id"], lambda r: (r[1], -r[2])),
    (["x", "name"], lambda r: (r[1], r[3])),
])
@pytest.mark.parametrize("slice_rows", [5, 100, 50_000])
def test_order_cuts_match_sorting(spark, mixed, order, key, slice_rows):
    if order[-1] == "name" and slice_rows == 5:
        slice_rows = 20
    rows = sorted(mixed, key=key)
    ranks = [0, 1, 999, 1500, 2999, 3000]
    cuts = O.order_cuts(frame(spark, mixed), order, ranks, slice_rows)
    assert cuts[-1] is None
    for k, cut in zip(ranks[:-1], cuts):
        names = [O.split_order(o)[0] for o in order]
        want = dict(zip(["g", "x", "id", "name"], rows[k]))
        assert cut == {n: want[n] for n in names}


def test_before_cut_selects_exactly_k_rows(spark, mixed):
    df = frame(spark, mixed)
    order = ["-x", "id"]
    for k, cut in zip([10, 1234], O.order_cuts(df, order, [10, 1234], 50)):
        assert df.where(O.before_cut(order, cut)).count() == k


def test_take_first_same_on_both_paths(spark, mixed):
    df = frame(spark, mixed)
    small = {r["id"] for r in O.take_first(df, ["x", "id"], 700).collect()}
    large = {r["id"] for r in O.take_first(df, ["x", "id"], 700, sort_limit=10).collect()}
    assert small == large and len(small) == 700
    assert O.take_first(df, ["x", "id"], 9999, sort_limit=10).count() == 3000


def test_order_cuts_of_empty_table(spark):
    assert O.order_cuts(frame(spark, []), ["x", "id"], [0]) == [None]


def test_sequence_counts_all_rows(spark, mixed):
    df = frame(spark, mixed).repartition(7)
    got = {r["id"]: r["pos"] for r in O.ordered_sequence(df, ["x", "id"]).collect()}
    want = {r[2]: i for i, r in enumerate(sorted(mixed, key=lambda r: (r[1], r[2])))}
    assert got == want


def test_sequence_per_group_keeps_null_group(spark, mixed):
    df = frame(spark, mixed)
    got = {r["id"]: r["pos"] for r in
           O.ordered_sequence(df, ["x", "id"], by=["g"], start=1).collect()}
    want = {}
    for g in {r[0] for r in mixed}:
        part = sorted((r for r in mixed if r[0] == g), key=lambda r: (r[1], r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(part)})
    assert got == want


def test_running_totals(spark, mixed):
    df = frame(spark, mixed)
    got = {r["id"]: (r["cum"], r["cum_total"]) for r in
           O.running_totals(df, ["-x", "id"], {"id": "cum"}, by=["g"]).collect()}
    assert len(got) == len(mixed)
    for g in {r[0] for r in mixed}:
        part = sorted((r for r in mixed if r[0] == g), key=lambda r: (-r[1], r[2]))
        total, run = sum(r[2] for r in part), 0
        for r in part:
            run += r[2]
            assert got[r[2]] == (run, total)


def test_blocks_split_equal_keys(spark):
    """A key that fills the table still spreads over several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit(1).alias("k"), "id")
        blocks = O.ordered_blocks(df, ["k", "id"]).groupBy(O.BLOCK).count().collect()
        assert len(blocks) == 4 and max(r["count"] for r in blocks) < 2500
        pos = O.ordered_sequence(df, ["k", "id"])
        assert pos.where("pos <> id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("order", [("v", "i"), ("-v", "i"), ("v", "-i"), ("-v", "-i")])
def test_nulls_and_nan_rank_as_sorted(spark, order):
    values = [None if i % 10 == 0 else float("nan") if i % 7 == 0 else float(i % 50)
              for i in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    want = [r["i"] for r in df.orderBy(*O.sort_columns(order)).collect()]
    ranks = [0, 39, 40, 41, 200, 341, 359, 360, 399]
    for slice_rows in (20, 10_000):
        cuts = O.order_cuts(df, order, ranks, slice_rows)
        assert [c["i"] for c in cuts] == [want[k] for k in ranks]
        for n in (30, 45, 390):
            got = O.take_first(df, order, n, sort_limit=5, slice_rows=slice_rows)
            assert sorted(r["i"] for r in got.collect()) == sorted(want[:n])


def test_ranks_of_a_level_share_their_scans(spark, monkeypatch):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 7_919 % 20_011).cast("double").alias("x"))
    levels, scans = [], []
    edges, kind = O._edges, type(df)
    agg = kind.agg
    monkeypatch.setattr(O, "_edges", lambda *a: levels.append(1) or edges(*a))
    monkeypatch.setattr(kind, "agg", lambda self, *a: scans.append(1) or agg(self, *a))
    ranks = [0, 500, 1_000, 2_000, 4_000, 8_000, 19_999]
    cuts = O.order_cuts(df, ["-x", "id"], ranks, slice_rows=3)
    want = [r["x"] for r in df.orderBy(F.desc("x")).collect()]
    assert [c["x"] for c in cuts] == [want[k] for k in ranks]
    assert len(scans) <= 2 * len(levels) + 1
