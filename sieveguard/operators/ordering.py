"""Global order without a single-partition window.

Three tools, all exact:

* :func:`order_cuts` finds the rows at given ranks with a few narrow passes and no
  sort of the table.  Splits, top shares and ``head`` are then plain filters.
* :func:`ordered_blocks` range-partitions and sorts once, and writes the result, so
  that block numbers stay fixed for every later pass.
* :func:`ordered_sequence` and :func:`running_totals` add row positions and running
  sums as "inside my block" plus "all blocks before mine".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveguard.scratch import written

BLOCK = "_block"
INDEX = "_index"

# Rows of a rank search that may be sorted to pick single rows out of them.
SLICE_ROWS = 50_000
SKETCH_ACCURACY = 10_000


def split_order(name: str) -> tuple[str, bool]:
    """``"-x"`` means x descending."""
    return (name[1:], True) if name.startswith("-") else (name, False)


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [
        F.col(c).desc() if down else F.col(c).asc()
        for c, down in map(split_order, order)
    ]


def _numeric(df: DataFrame, name: str) -> Column | None:
    """A number that sorts like the column, or None for other types."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, (T.NumericType, T.DateType)):
        return F.unix_date(name) if isinstance(kind, T.DateType) else F.col(name)
    return None


def before_cut(order: Sequence[str], cut: dict) -> Column:
    """True for rows that sort strictly before ``cut``, in lexicographic order."""
    test = F.lit(False)
    for name, down in reversed([split_order(o) for o in order]):
        col, value = F.col(name), F.lit(cut[name])
        # Nulls come first in ascending and last in descending order, as Spark sorts them.
        if cut[name] is None:
            ahead = col.isNotNull() if down else F.lit(False)
        elif down:
            ahead = F.coalesce(col > value, F.lit(False))
        else:
            ahead = F.coalesce(col < value, F.lit(True))
        test = ahead | (col.eqNullSafe(value) & test)
    return test


def order_cuts(df: DataFrame, order: Sequence[str], ranks: Sequence[int],
               slice_rows: int = SLICE_ROWS) -> list[dict | None]:
    """For each rank k, the order values of the row with exactly k rows before it.

    ``None`` stands for a rank past the end.  The order must be total (end it with a
    unique column).  Nulls and NaN rank as Spark sorts them.  Each pass reads the order columns
    only: a quantile sketch brackets every rank, one aggregation counts exactly, and
    the bracket shrinks by about the sketch accuracy per pass.  Rows that tie on the
    first column are searched on the next one; a tie on a text column is resolved by
    :func:`ordered_sequence` over the tied rows.
    """
    names = [split_order(o)[0] for o in order]
    df = df.select(*names)
    total = df.count()
    wanted = {i: k for i, k in enumerate(ranks) if 0 <= k < total}
    found: dict[int, dict] = {}
    if wanted:
        found, small = _search(df, list(order), wanted, total, slice_rows)
        found.update(_pick(df, order, small))
    return [found.get(i) for i in range(len(ranks))]


# Rows under a condition, and for each wanted cut its rank among them.
Bracket = tuple[Column, dict[int, int]]


@dataclass
class _Span:
    """Rows under ``test``, in ``order`` from here on, and the ranks wanted among them.

    ``plain``: the first column has no null and no NaN in them.
    """

    test: Column
    order: list[str]
    wanted: dict[int, int]
    total: int
    plain: bool = False

    @property
    def column(self) -> tuple[str, bool]:
        return split_order(self.order[0])


def _search(df: DataFrame, order: list[str], wanted: dict[int, int], total: int,
            slice_rows: int) -> tuple[dict[int, dict], list[Bracket]]:
    """Shrink the rows around the wanted ranks to brackets of at most ``slice_rows`` rows.

    All brackets of a level share its scans: one for quantiles, one for exact counts, and one more
    where a column may hold nulls or NaN.
    """
    found: dict[int, dict] = {}
    small: list[Bracket] = []
    todo = [_Span(F.lit(True), order, wanted, total)]
    while todo:
        level, todo = todo, []
        open_ = _settle(df, level, slice_rows, found, small)
        apart, ahead = _ends_apart(df, open_, found)
        todo += ahead
        open_ = _settle(df, apart, slice_rows, found, small)
        for span, edges, below, upto in _edges(df, open_):
            todo += _inside(df, span, edges, below, upto, found)
    return found, small


def _settle(df: DataFrame, spans: list[_Span], slice_rows: int, found: dict[int, dict],
            small: list[Bracket]) -> list[_Span]:
    """Set small spans aside, number those that start with a text column; the rest is open."""
    left = []
    for span in spans:
        if span.total <= slice_rows:
            small.append((span.test, span.wanted))
        elif _numeric(df, span.column[0]) is None:
            places = sorted(set(span.wanted.values()))
            hits = {r["pos"]: r.asDict() for r in ordered_sequence(
                df.where(span.test), span.order).where(F.col("pos").isin(places)).collect()}
            found.update({i: {n: hits[k][n] for n in df.columns} for i, k in span.wanted.items()})
        else:
            left.append(span)
    return left


def _ends_apart(df: DataFrame, spans: list[_Span], found: dict[int, dict]
                ) -> tuple[list[_Span], list[_Span]]:
    """Parts of plain values, to go on with, and parts of nulls and NaN, which the next column of
    the order tells apart."""
    tests = []
    for span in (s for s in spans if not s.plain):
        name = span.column[0]
        null, nan = F.col(name).isNull(), F.lit(False)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            nan = F.coalesce(F.isnan(name), F.lit(False))
        tests.append((null, nan))
    plain, later = [s for s in spans if s.plain], []
    if not tests:
        return plain, later
    mixed = [s for s in spans if not s.plain]
    counts = df.agg(*[F.count_if(s.test & t).alias(f"c{i}_{j}") for i, (s, own) in enumerate(
        zip(mixed, tests)) for j, t in enumerate(own)]).first()
    for i, (span, (null, nan)) in enumerate(zip(mixed, tests)):
        nulls, nans = counts[f"c{i}_0"], counts[f"c{i}_1"]
        parts = [(null, nulls), (~null & ~nan, span.total - nulls - nans), (nan, nans)]
        before = 0
        for own, size in reversed(parts) if span.column[1] else parts:
            local = {i: k - before for i, k in span.wanted.items() if before <= k < before + size}
            before += size
            if not local:
                continue
            part = _Span(span.test & own, span.order, local, size, True)
            if own is parts[1][0]:
                plain.append(part)
            else:
                later += _next_column(df, part, found)
    return plain, later


def _next_column(df: DataFrame, span: _Span, found: dict[int, dict]) -> list[_Span]:
    """Go on with the next column among rows that tie on the first, or take any of them."""
    if len(span.order) > 1:
        return [_Span(span.test, span.order[1:], span.wanted, span.total)]
    one = df.where(span.test).first().asDict()
    found.update({i: one for i in span.wanted})
    return []


def _edges(df: DataFrame, spans: list[_Span]
           ) -> Iterator[tuple[_Span, list, list[int], list[int]]]:
    """For each span, values around its wanted ranks, and how many rows lie below and up to them."""
    if not spans:
        return
    margin, keys, sketches = 2.0 / SKETCH_ACCURACY, [], []
    for i, span in enumerate(spans):
        name, down = span.column
        number = _numeric(df, name)
        keys.append(F.when(span.test, -number if down else number))
        probs = sorted({min(1.0, max(0.0, k / span.total + d))
                        for k in span.wanted.values() for d in (-margin, margin)})
        sketches += [F.percentile_approx(keys[i], probs, SKETCH_ACCURACY).alias(f"q{i}"),
                     F.min(keys[i]).alias(f"lo{i}"), F.max(keys[i]).alias(f"hi{i}")]
    marks = df.agg(*sketches).first()
    edges = [sorted({marks[f"lo{i}"], marks[f"hi{i}"], *marks[f"q{i}"]}) for i in range(len(spans))]
    counts = df.agg(*[F.count_if(t).alias(f"{n}{i}_{j}") for i, own in enumerate(edges)
                      for j, e in enumerate(own) for n, t in (("b", keys[i] < e),
                                                              ("u", keys[i] <= e))]).first()
    for i, span in enumerate(spans):
        below, upto = ([counts[f"{n}{i}_{j}"] for j in range(len(edges[i]))] for n in "bu")
        yield span, edges[i], below, upto


def _inside(df: DataFrame, span: _Span, edges: list, below: list[int], upto: list[int],
            found: dict[int, dict]) -> list[_Span]:
    """Each rank falls either on an edge value or strictly between two edges."""
    name, down = span.column
    key = -_numeric(df, name) if down else _numeric(df, name)
    groups: dict[tuple[int, bool], dict[int, int]] = {}
    for i, k in span.wanted.items():
        j = max(j for j in range(len(edges)) if below[j] <= k)
        groups.setdefault((j, k < upto[j]), {})[i] = k
    out = []
    for (j, on_edge), part in groups.items():
        if on_edge:
            ties = _Span(span.test & (key == F.lit(edges[j])), span.order,
                         {i: k - below[j] for i, k in part.items()}, upto[j] - below[j])
            out += _next_column(df, ties, found)
        else:
            between = span.test & (key > F.lit(edges[j])) & (key < F.lit(edges[j + 1]))
            out.append(_Span(between, span.order, {i: k - upto[j] for i, k in part.items()},
                             below[j + 1] - upto[j], True))
    return out


def _pick(df: DataFrame, order: Sequence[str], brackets: list[Bracket]) -> dict[int, dict]:
    """The wanted rows of all brackets in one job; each bracket's size was checked."""
    if not brackets:
        return {}
    place, asked = F.lit(None).cast("int"), F.lit(False)
    for b, (test, wanted) in enumerate(brackets):
        place = F.when(test, b).otherwise(place)
        asked = asked | ((F.col("_bracket") == b) & F.col("_rank").isin(
            sorted({k + 1 for k in wanted.values()})))
    inside = Window.partitionBy("_bracket").orderBy(*sort_columns(order))
    rows = (df.withColumn("_bracket", place).where("_bracket is not null")
            .withColumn("_rank", F.row_number().over(inside)).where(asked).collect())
    hits = {(r["_bracket"], r["_rank"]): r for r in rows}
    return {i: {n: hits[b, k + 1][n] for n in df.columns}
            for b, (_, wanted) in enumerate(brackets) for i, k in wanted.items()}


def take_first(df: DataFrame, order: Sequence[str], n: int,
               sort_limit: int = 10_000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The first n rows in order.

    Small n is a distributed top-n.  Large n would make that operator hold n rows in
    every task, so it becomes a rank search and a filter.
    """
    if n <= sort_limit:
        return df.orderBy(*sort_columns(order)).limit(n)
    cut = order_cuts(df, order, [n], slice_rows)[0]
    return df if cut is None else df.where(before_cut(order, cut))


def ordered_blocks(df: DataFrame, order: Sequence[str], name: str = "blocks") -> DataFrame:
    """Sort by range partitions and write, with block number and index in block.

    Without a fixed partition number the adaptive planner sizes the blocks, so equal
    keys up to a third of all rows still spread as long as the order is total.
    """
    cols = sort_columns(order)
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    low_bits = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(
        ranged.select("*", F.spark_partition_id().alias(BLOCK), low_bits.alias(INDEX)),
        name)


def ordered_sequence(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                     start: int = 0, name: str = "pos") -> DataFrame:
    """Position of each row in the order, counted from ``start`` (per ``by`` group)."""
    keys = _group_keys(by)
    stamped = ordered_blocks(df, [*by, *order], "sequence").withColumns(keys)
    cells = stamped.groupBy(*keys, BLOCK).agg(F.count("*").alias("_rows"),
                                              F.min(INDEX).alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, BLOCK, (F.coalesce(F.sum("_rows").over(ahead), F.lit(0))
                       - F.col("_first") + F.lit(start)).alias("_shift"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per block, at most one block per task
    joined = stamped.join(offsets, [*keys, BLOCK])
    return joined.withColumn(name, F.col(INDEX) + F.col("_shift")).drop(
        "_shift", INDEX, BLOCK, *keys)


def _group_keys(by: Sequence[str]) -> dict[str, Column]:
    """Group columns wrapped in structs, so that a null group joins with itself."""
    return {f"_k{i}": F.struct(F.col(c)) for i, c in enumerate(by)}


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Running sums in order, per group.

    ``sums`` maps a column to the name of its running sum; ``<name>_total`` holds the
    sum over the whole group.
    """
    keys = _group_keys(by)
    stamped = ordered_blocks(df, [*by, *order], "running").withColumns(keys)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(INDEX).rowsBetween(
        Window.unboundedPreceding, 0)
    local = stamped.withColumns({f"_in_{n}": F.sum(c).over(inside)
                                 for c, n in sums.items()})
    cells = stamped.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(f"_cell_{n}") for c, n in sums.items()])
    group = Window.partitionBy(*keys)
    ahead = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(f"_cell_{n}").over(ahead), F.lit(0)).alias(f"_pre_{n}")
          for n in sums.values()],
        *[F.sum(f"_cell_{n}").over(group).alias(f"{n}_total") for n in sums.values()])
    if not by:
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, [*keys, BLOCK])
    return joined.withColumns(
        {n: F.col(f"_in_{n}") + F.col(f"_pre_{n}") for n in sums.values()}
    ).drop(BLOCK, INDEX, *keys,
           *[f"{p}{n}" for n in sums.values() for p in ("_in_", "_pre_")])
