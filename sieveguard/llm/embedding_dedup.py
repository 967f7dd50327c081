"""Embedding near-duplicates by dual traversal of cover trees, with exact threshold links.

Unit vectors at cosine ``c`` are ``sqrt(2 - 2c)`` apart, so links are pairs within a fixed
distance, and a tree node (a centre and the largest distance to what it covers) can be paired
with another only if their centres are no further apart than both radii and that distance.

Upper levels are spread over the cluster: a cell with too many vectors for one task is split
around some of its own, each vector going to the nearest; pairs of cells are followed from level
to level by joins with their children, and dropped by the bound. Each pair of leaf cells that is
left is one unit of work. In it, cover trees are built over both cells and traversed together.
The pairs of leaves that are left are multiplied in single precision, whose error is bounded:
outside the bound it decides, inside it the cosine is taken in double precision from the vectors
as given.

Vectors are written once, and once more for each level that splits their cell. Pairs of different
cells are compared in rounds, each of about as many rows as there are vectors, and a round's
shuffle files are dropped with it: disk follows the input, however many pairs of cells are left.

Equal vectors are compared once, with their number of copies. A unit returns link counts per
vector and a spanning forest of its links, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing; so do vectors of different lengths. Rows that repeat a vec_id are
vectors of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import clear_names, table
from sieveguard.llm.components import components
from sieveguard.llm.registry import query
from sieveguard.scratch import written

CELL = 1 << 16            # vectors of a leaf cell, about, and
CELL_BYTES = 32 << 20     # their bytes as doubles
LEAF = 1024               # vectors of a leaf of a cover tree, about
TILE = 2048               # vectors that a leaf is multiplied with at a time
EDGES = 1 << 18           # links kept before they are put into components
FAN_OUT = 64              # centres a cell is split around at one level, about
LEVELS = 4
SALT = 8192               # vectors compared with their cell's centres in one task at a time
SLACK = 1e-6              # for rounding in the pruning distances
TASK_ROWS = 1 << 17       # vectors of a task's units, about
PAIRS_AT_ONCE = 100_000   # pairs of cells that are broadcast
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can have links."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
            & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0))


def vector_key(name: str) -> Column:
    return F.xxhash64(name)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very small or large values stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested centres with covering radii over unit vectors.

    A node is a run of rows in ``order``, with a centre and the largest distance to its rows.
    A node with more than ``leaf`` rows is split around some of its own, each row going to the
    nearest; children stand together. Rows that no centre parts stay in one leaf.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.start, self.end, self.centre, self.reach = [0], [len(x)], [x[0]], [2.0]
        self.first, self.children = [0], [0]
        node = 0
        while node < len(self.start):
            low, high = self.start[node], self.end[node]
            if high - low > leaf:
                self._split(x, node, low, high, int(min(FAN_OUT, max(8, 1.5 * (high - low) / leaf))))
            node += 1
        for name in ("start", "end", "reach", "first", "children"):
            setattr(self, name, np.array(getattr(self, name)))
        self.centre = np.array(self.centre)

    def _split(self, x: np.ndarray, node: int, low: int, high: int, wanted: int) -> None:
        rows = self.order[low:high]
        lead = x[rows[np.linspace(0, len(rows) - 1, wanted).astype(np.int64)]]
        own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
        for i in range(0, len(rows), SALT):
            apart = distances(x[rows[i:i + SALT]], lead)
            own[i:i + SALT] = apart.argmin(axis=1)
            far[i:i + SALT] = apart.min(axis=1)
        sizes = np.bincount(own, minlength=wanted)
        if sizes.max() == len(rows):
            return
        order = np.argsort(own, kind="stable")
        self.order[low:high] = rows[order]
        reach = np.zeros(wanted)
        np.maximum.at(reach, own, far)
        kept = np.flatnonzero(sizes)
        ends = low + np.cumsum(sizes)
        self.first[node], self.children[node] = len(self.start), len(kept)
        self.start += (ends - sizes)[kept].tolist()
        self.end += ends[kept].tolist()
        self.reach += (reach[kept] + SLACK).tolist()
        self.centre += list(lead[kept])
        self.first += [0] * len(kept)
        self.children += [0] * len(kept)


def below(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes`` (a leaf is its own child), and which of ``nodes`` each is of."""
    n = tree.children[nodes]
    own = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(nodes)), own)
    rank = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return np.where(n > 0, tree.first[nodes], nodes)[owner] + rank, owner


def dual_pairs(a: CoverTree, b: CoverTree, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of both trees that may hold rows within ``limit``; of one tree with itself
    each pair once."""
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        done = (a.children[left] == 0) & (b.children[right] == 0)
        if done.all():
            return left, right
        left, owner = below(a, left)
        right, owner = below(b, right[owner])
        left = left[owner]
        near = np.ones(len(left), bool) if a is not b else a.start[left] <= a.start[right]
        left, right = left[near], right[near]
        apart = np.sqrt(np.maximum(2 - 2 * np.einsum(
            "ij,ij->i", a.centre[left], b.centre[right]), 0))
        near = apart <= limit + a.reach[left] + b.reach[right] + SLACK
        left, right = left[near], right[near]


def runs(tree: CoverTree, leaves: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spans of rows of some leaves, at most ``most`` rows each; neighbours are joined."""
    out: list[tuple[int, int]] = []
    for leaf in leaves[np.argsort(tree.start[leaves])]:
        low, high = int(tree.start[leaf]), int(tree.end[leaf])
        if out and out[-1][1] == low:
            low = out.pop()[0]
        out.append((low, high))
    return [(i, min(i + most, high)) for low, high in out for i in range(low, high, most)]


def connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put linked rows under the least row that links connect them with."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


class Links:
    """Links between rows: their number for each row, and what they connect."""

    def __init__(self, n: np.ndarray) -> None:
        self.n, self.count, self.root = n, np.zeros(len(n)), np.arange(len(n))
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for at, other in ((i, j), (j, i)):
            low = int(at.min())
            own = np.bincount(at - low, self.n[other])
            self.count[low:low + len(own)] += own
        apart = self.root[i] != self.root[j]
        self.kept.append((i[apart], j[apart]))
        self.held += int(apart.sum())
        if self.held > EDGES:
            self.settle()

    def settle(self) -> None:
        if self.kept:
            connect(self.root, *(np.concatenate(x) for x in zip(*self.kept)))
        self.kept, self.held = [], 0


def linked(x: np.ndarray, cut: int, n: np.ndarray, cosine: float) -> Links:
    """Links between the rows before and after ``cut``, or of all rows if there are none after.

    ``n`` are the copies that a row stands for.
    """
    out, same = Links(n), cut == len(x)
    if cut == 0:
        return out
    unit = unit_rows(x)
    a = CoverTree(unit[:cut])
    b = a if same else CoverTree(unit[cut:])
    left, right = dual_pairs(a, b, np.sqrt(2 - 2 * cosine))
    # Places in tree order, and the rows that stand there.
    rows_a, rows_b = a.order, b.order if same else b.order + cut
    fast_a = unit[rows_a].astype(np.float32)
    fast_b = fast_a if same else unit[rows_b].astype(np.float32)
    del unit
    error = (x.shape[1] + 8) * 1.2e-7
    by_left = np.argsort(left, kind="stable")
    leaves, first = np.unique(left[by_left], return_index=True)
    for leaf, own in zip(leaves, np.split(right[by_left], first[1:])):
        low, high = int(a.start[leaf]), int(a.end[leaf])
        spans = runs(b, own, TILE)
        for top in range(low, high, LEAF):
            some = fast_a[top:min(top + LEAF, high)]
            for start, end in spans:
                if same and end <= top:
                    continue
                cos = (some @ fast_b[start:end].T).ravel()
                hits = np.flatnonzero(cos >= np.float32(cosine - error))
                if not len(hits):
                    continue
                p, q = hits // (end - start) + top, hits % (end - start) + start
                unsure = cos[hits] < cosine + error
                if same:
                    fine = p < q
                    p, q, unsure = p[fine], q[fine], unsure[fine]
                i, j = rows_a[p], rows_b[q]
                good = ~unsure
                good[unsure] = exact(x[i[unsure]], x[j[unsure]]) >= cosine
                if good.any():
                    out.add(i[good], j[good])
    out.settle()
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dots = np.einsum("ij,ij->i", x, y)
    return dots / (np.sqrt((x ** 2).sum(axis=1)) * np.sqrt((y ** 2).sum(axis=1)))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a query's shuffle files go when it has ended (what it wrote is a table)."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def cell_sizes(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("cell").agg(F.count("*").alias("total")), "sizes")


def split_cells(rows: DataFrame, sizes: DataFrame, level: int, cell: int, fan_out: int
                ) -> tuple[DataFrame, DataFrame]:
    """Split cells of ``rows(id, cell, v, n)`` with more than ``cell`` vectors.

    Returns the rows in their new cells and the cells (cell, parent, v, reach); a cell that is
    not split is its own child. Only rows that move are written again.
    """
    kind = rows.schema["v"].dataType.simpleString()
    crowded = F.broadcast(sizes.filter(F.col("total") > cell))   # a row for ``cell`` vectors or more
    draw = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 30))
    wanted = F.greatest(F.lit(8), F.least(F.lit(fan_out), F.ceil(F.col("total") * 1.5 / cell)))
    full = rows.join(crowded, "cell").withColumn(
        "centre", draw * F.col("total") < wanted * F.lit(1 << 30)).withColumn(
        "salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.ceil(F.col("total") / SALT)))
    middle = written(full.filter("centre").select("cell", "total", "id", "v"), "centres")
    centres = middle.select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / SALT) - 1))
        .alias("salt"), F.col("id").alias("cid"), F.col("v").alias("cv"))

    def assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        base = left.select(["id", "cell", "v", "n"])
        if not left.num_rows or not right.num_rows:
            own, reach = left["cell"].to_numpy(), np.full(left.num_rows, 2.0)
        else:
            right = right.sort_by("cid")
            cx = unit_rows(matrix(right["cv"]))
            apart = distances(unit_rows(matrix(left["v"])), cx)
            best = apart.argmin(axis=1)
            own, reach = right["cid"].to_numpy()[best], apart[np.arange(len(best)), best]
        return base.append_column("own", pa.array(own, pa.int64())).append_column(
            "far", pa.array(reach, pa.float64()))

    moved = written(full.groupBy("cell", "salt").cogroup(centres.groupBy("cell", "salt"))
                    .applyInArrow(assign, f"id long, cell long, v {kind}, n long,"
                                          " own long, far double").withColumn(
        "next", F.xxhash64(F.lit(level), "cell", "own")), "moved")
    lead = moved.groupBy("next", "cell", "own").agg((F.max("far") + SLACK).alias("reach"))
    children = lead.join(middle.select(F.col("id").alias("own"), "v"), "own", "left").select(
        F.col("next").alias("cell"), F.col("cell").alias("parent"), "v", "reach")
    # A cell without a centre may hold anything.
    kept = sizes.filter(F.col("total") <= cell).select(
        "cell", F.col("cell").alias("parent"), F.lit(None).cast(kind).alias("v"),
        F.lit(2.0).alias("reach"))
    whole = rows.join(crowded.select("cell"), "cell", "left_anti")
    out = whole.select("id", "cell", "v", "n").union(
        moved.select("id", F.col("next").alias("cell"), "v", "n"))
    return out, written(kept.union(children), "tree")


def gap(a: str, b: str) -> Column:
    """Distance of two cell centres given as arrays, taken as unit vectors."""
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda s, p: s + p)
    cos = dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
    return F.sqrt(F.greatest(F.lit(2.0) - 2 * cos, F.lit(0.0)))


def work_units(rows: DataFrame, limit: float, cell: int, fan_out: int,
               levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaf cells of ``rows(id, cell, v, n)``, each with its parts, and the pairs (a, pa, b, pb) of
    them to compare, with their number of vectors. A part's pair with itself has one part."""
    sizes = cell_sizes(rows)
    pairs = sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for level in range(levels):
        top = sizes.agg(F.max("total")).first()[0] or 0
        if top <= cell:
            break
        rows, tree = split_cells(rows, sizes, level, cell, fan_out)
        ca = tree.select(F.col("parent").alias("a"), F.col("cell").alias("a2"),
                         F.col("v").alias("va"), F.col("reach").alias("ra"))
        cb = tree.select(F.col("parent").alias("b"), F.col("cell").alias("b2"),
                         F.col("v").alias("vb"), F.col("reach").alias("rb"))
        near = (F.col("a2") == F.col("b2")) | F.col("va").isNull() | F.col("vb").isNull() | (
            gap("va", "vb") <= F.lit(limit + SLACK) + F.col("ra") + F.col("rb"))
        # A pair of one cell with itself gives each pair of its children once.
        once = (F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))
        pairs = written(pairs.join(ca, "a").join(cb, "b").filter(once & near).select(
            F.col("a2").alias("a"), F.col("b2").alias("b")), "pairs")
        sizes = cell_sizes(rows)
    # What is still crowded (nearly equal vectors) is dealt into parts of the same cell.
    parts = sizes.withColumn("parts", F.ceil(F.col("total") / F.lit(2.0 * cell)))
    many = F.broadcast(parts.filter("parts > 1").select("cell", "parts"))
    rows = rows.join(many, "cell", "left").withColumn("part", F.pmod(
        F.xxhash64(F.lit("part"), "id"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    side = lambda c, n: parts.select(
        F.col("cell").alias(c), F.col("parts").alias(f"n{c}"),
        F.ceil(F.col("total") / F.col("parts")).alias(n))
    dealt = (pairs.join(side("a", "one"), "a").join(side("b", "two"), "b")
             .withColumn("pa", spread("na")).withColumn("pb", spread("nb"))
             .filter("a <> b or pa <= pb").select("a", "pa", "b", "pb", F.when(
                 (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb")), F.col("one")).otherwise(
                 F.col("one") + F.col("two")).alias("vectors")))
    return rows, written(dealt, "units")


def links_of(distinct: DataFrame, cosine: float, cell: int = CELL, fan_out: int = FAN_OUT,
             levels: int = LEVELS) -> DataFrame:
    """(a, b, links) over ``distinct(id, cell, v, n)``: rows with b null count the linked rows
    of vector a in one unit; the others are edges that connect what links connect."""
    spark = distinct.sparkSession
    rows, units = work_units(distinct, np.sqrt(2 - 2 * cosine), cell, fan_out, levels)
    unit = ["a", "pa", "b", "pb"]
    alone = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
    sums = units.groupBy(alone.alias("alone")).agg(F.count("*").alias("units"),
                                                   F.sum("vectors").alias("vectors")).collect()
    known = {r["alone"]: (r["units"], r["vectors"]) for r in sums}
    (singles, total), (crossed, weight) = known.get(True, (0, 0)), known.get(False, (0, 0))
    rounds = -(-weight // max(total, 1))
    cross = units.filter(~alone).withColumn("round", F.pmod(
        F.xxhash64(F.lit("round"), *unit), F.lit(max(rounds, 1)))).drop("vectors")

    def compare(found: pa.Table) -> pa.Table:
        found = found.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, n = found["id"].to_numpy(), found["n"].to_numpy()
        cut = int((found["side"].to_numpy() == 0).sum())
        links = linked(matrix(found["v"]), cut, n, cosine)
        some = np.flatnonzero(links.count)
        tree = np.flatnonzero(links.root != np.arange(len(ids)))
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[tree]])),
            "b": pa.array(np.concatenate([ids[some], ids[links.root[tree]]]),
                          mask=np.arange(len(some) + len(tree)) < len(some)),
            "links": pa.array(np.concatenate(
                [links.count[some], np.zeros(len(tree))]).astype(np.int64))})

    def compared(sides: DataFrame, count: int, vectors: int) -> DataFrame:
        # Units cost their work and not their bytes, so tasks are not merged by bytes.
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(4 * count, usual), -(-vectors // TASK_ROWS))
        return written(sides.repartition(tasks, *unit).groupBy(*unit).applyInArrow(
            compare, "a long, b long, links long"), "links")

    own = rows.select(F.col("cell").alias("a"), F.col("part").alias("pa"), F.col("cell").alias("b"),
                      F.col("part").alias("pb"), F.lit(0).alias("side"), "id", "v", "n")
    out = compared(own, singles, total)
    for i in range(rounds):
        now = cross.filter(F.col("round") == i).drop("round")
        if crossed <= PAIRS_AT_ONCE * rounds:
            now = F.broadcast(now)
        left, right = (rows.withColumnsRenamed({"cell": c, "part": p}).join(now, [c, p]).select(
            *unit, F.lit(side).alias("side"), "id", "v", "n")
            for side, (c, p) in enumerate((("a", "pa"), ("b", "pb"))))
        out = out.union(compared(left.union(right), -(-crossed // rounds), -(-weight // rounds)))
    return out


def working(rows: DataFrame) -> Column:
    """``embedding`` as it is compared: floats as they are, other numbers as doubles.

    Doubles are divided by a power of two near the largest, which changes no cosine and keeps
    squares of very large or small values in range.
    """
    if rows.schema["embedding"].dataType.simpleString() == "array<float>":
        return F.col("embedding")
    v = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(v, F.abs))
    scale = F.pow(F.lit(2.0), F.least(F.floor(F.log2(top)), F.lit(1023)))
    return F.transform(v, lambda x: x / scale)


def near_vectors(rows: DataFrame, cosine: float = 0.98, cell: int | None = None,
                 fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """``rows(vec_id, embedding, label)`` with ``n_links``, ``component_id``, ``kept``."""
    clear_names(rows, ["n_links", "component_id", "kept", "_id", "_n", "_links", "_root", "_key"])
    with shuffles_dropped(rows.sparkSession):
        return _near_vectors(rows, cosine, cell, fan_out, levels)


def _near_vectors(rows: DataFrame, cosine: float, cell: int | None, fan_out: int, levels: int
                  ) -> DataFrame:
    good = rows.filter(usable(F.col("embedding"), F.col("label")))
    distinct = written(good.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("_n")).withColumns(
        {"_id": F.monotonically_increasing_id(), "_key": vector_key("embedding")}), "vectors")
    if cell is None:
        longest = distinct.agg(F.max(F.size("embedding"))).first()[0] or 1
        cell = max(LEAF, min(CELL, CELL_BYTES // (8 * longest)))
    found = links_of(distinct.select(
        F.col("_id").alias("id"), F.xxhash64("label", F.size("embedding")).alias("cell"),
        working(distinct).alias("v"), F.col("_n").alias("n")),
        cosine, cell, fan_out, levels)
    counts = found.filter("b is null").groupBy(F.col("a").alias("_id")).agg(
        F.sum("links").alias("_links"))
    roots = written(components(found.filter("b is not null").select("a", "b")), "roots").select(
        F.col("node").alias("_id"), F.col("root").alias("_root"))
    # Vectors are found again by a hash, unless two of a label share one.
    shared = distinct.groupBy("label", "_key").count().filter("count > 1").limit(1).count()
    known = (distinct.join(counts, "_id", "left").join(roots, "_id", "left")
             .withColumn("_root", F.coalesce("_root", "_id")))
    named = known.groupBy("_root").agg(F.min("least").alias("component_id"))
    facts = written(known.join(named, "_root").select(
        F.col("label").alias("_label"), F.col("_key").alias("_own"),
        *([F.col("embedding").alias("_embedding")] if shared else []), "component_id",
        (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links")), "facts")
    keyed = rows.withColumn("_key", F.when(
        usable(F.col("embedding"), F.col("label")), vector_key("embedding")))
    same = (keyed["label"] == facts["_label"]) & (keyed["_key"] == facts["_own"])
    if shared:
        same = same & (keyed["embedding"] == facts["_embedding"])
    out = keyed.join(facts, same, "left")
    own = F.coalesce("component_id", "vec_id")
    return out.drop("_label", "_embedding", "_key", "_own").withColumns({
        "n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": own,
        "kept": F.coalesce(F.col("vec_id") == own, F.lit(False))})


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", "kept")
