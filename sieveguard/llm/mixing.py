"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Document rates stay as near to their prior as possible
(in relative entropy, every word counting alike) while meeting the targets: the solution is
``min(cap, prior * exp(lambda_source))``. The convex dual in the lambdas is solved by Newton
steps whose gradient and curvature are sums over all documents, taken by Spark. Rates are
then rounded into whole copies: in an order drawn from the record itself, documents take the
extra copy until the words missing from their source are filled.

Nulls: a null source is a source of its own, ordered last; a null text has no words. Records
equal in id and text come next to each other in that order, told apart by their place in the
input alone: which of them takes a copy is of no account, how many do is. Long texts are counted
whole. Columns named like an added one are refused. Empty tables give empty results. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import WORD, checked_rows, clear_names, table
from sieveguard.llm.registry import query
from sieveguard.scratch import written

MAX_SOURCES = 100_000
BLOCKS = 4096             # parts of a source searched for the place where it is full
EDGE_ROWS = 20_000        # rows of such a part that are put in order; more are parted again
LEVELS = 4                # of parts; the last tell all places of the order apart
TIE_BITS = 20             # of a place, by the record's place in the input
STEPS = 60


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], share: float,
                   cap: float) -> list[float]:
    """Split ``share`` of all words by weight; no source gets more than ``cap`` times its own.

    What is over a cap is shared again by weight among the sources below theirs.
    """
    budget = share * sum(sizes)
    targets = [0.0] * len(sizes)
    rest = list(range(len(sizes)))
    while rest:
        unit = budget / sum(weights[i] for i in rest)
        full = [i for i in rest if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in rest:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = cap * float(sizes[i])
            budget -= targets[i]
        rest = [i for i in rest if i not in set(full)]
        budget = max(budget, 0.0)
    return targets


def balance(profile: DataFrame, targets: dict[int, float], cap: float) -> dict[int, float]:
    """Dual variables of ``profile(sid, prior, words)`` for the targets of each source.

    The duals start at 0, where every rate is its prior. One aggregation over the profile per
    Newton step; steps are cut to 1 in size, and end when every source is within 1e-9 of its
    target or no rate can grow any more.
    """
    spark = profile.sparkSession
    start = {r["sid"]: r["w"] for r in profile.groupBy("sid").agg(
        F.sum(F.col("prior") * F.col("words")).alias("w")).collect()}
    duals = {s: 0.0 if t > 0 and start.get(s) else -math.inf for s, t in targets.items()}
    live = {s for s, d in duals.items() if d > -math.inf}
    # Where rates are cut off the curve bends, so steps stay between the duals known to be too
    # small and too large.
    low, high = {s: -math.inf for s in live}, {s: math.inf for s in live}
    for _ in range(STEPS):
        if not live:
            break
        now = spark.createDataFrame([(s, duals[s]) for s in sorted(live)],
                                    "sid int, dual double")
        rate = F.col("prior") * F.exp("dual")
        sums = profile.join(F.broadcast(now), "sid").groupBy("sid").agg(
            F.sum(F.col("words") * F.least(F.lit(cap), rate)).alias("taken"),
            F.sum(F.when(rate < cap, F.col("words") * rate).otherwise(0.0)).alias("slope"))
        for r in sums.collect():
            gap = r["taken"] - targets[r["sid"]]
            if abs(gap) <= 1e-9 * targets[r["sid"]] or (r["slope"] == 0 and gap < 0):
                live.discard(r["sid"])
            else:
                s, now_at = r["sid"], duals[r["sid"]]
                (low if gap < 0 else high)[s] = now_at
                step = -gap / r["slope"] if r["slope"] > 0 else -1.0
                duals[s] = now_at + max(-1.0, min(1.0, step))
                if not low[s] < duals[s] < high[s]:
                    duals[s] = (low[s] + high[s]) / 2
    return duals


def _place() -> Column:
    """53 bits: drawn from the record, the last TIE_BITS of them from where it stands."""
    own = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11 + TIE_BITS)
    row = F.xxhash64(F.lit("tie"), F.monotonically_increasing_id())
    return F.shiftleft(own, TIE_BITS) + F.shiftrightunsigned(row, 64 - TIE_BITS)


def mix_copies(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1),
               cap: float = 2.0, prior: str | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``docs`` needs ``doc_id, text, source``. Sources in code-point order weigh ``weights``,
    repeating. The text is read twice: once for sizes, once for the result.
    """
    clear_names(docs, ["size", "source_size", "target", "rate", "copies", "taken", "sid",
                       "_source", "_u", "_t", "_base", "_at", "_fill", "_dual", "_prior"])
    base = F.col(prior).cast("double") if prior else F.lit(1.0)
    sized = docs.withColumns({
        "size": word_count(), "_prior": F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(0.0)),
        "_u": _place()})
    narrow = written(sized.select("source", "size", "_prior", "_u"), "mix")
    rows = checked_rows(narrow.groupBy("source").agg(F.sum("size").alias("n")),
                        MAX_SOURCES, "sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = capped_targets([r["n"] for r in rows],
                          [float(weights[i % len(weights)]) for i in range(len(rows))],
                          share, cap)
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r["source"]) for i, r in enumerate(rows)],
                                  "sid int, _source string")
    keyed = narrow.join(F.broadcast(names), narrow["source"].eqNullSafe(
        names["_source"])).drop("_source")
    profile = written(keyed.groupBy("sid", F.col("_prior").alias("prior")).agg(
        F.sum("size").alias("words")), "mix_profile")
    duals = balance(profile, dict(enumerate(aims)), cap)
    facts = spark.createDataFrame(
        [(i, r["source"], r["n"], aims[i], duals[i]) for i, r in enumerate(rows)],
        "sid int, _source string, source_size long, target double, _dual double")

    rated = _rates(keyed.join(F.broadcast(facts.drop("_source")), "sid"), cap)
    per_source = facts.join(F.broadcast(_fill_points(rated)), "sid", "left")
    # One row per source, MAX_SOURCES at most.
    out = _rates(sized.join(F.broadcast(per_source),
                            sized["source"].eqNullSafe(F.col("_source"))), cap)
    extra = ((F.col("_t") <= F.col("_at")) | (F.col("_t") == F.col("_fill"))) & (
        F.col("size") > 0)
    return (out.withColumn("copies", F.col("_base") + F.when(extra, 1).otherwise(0))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .drop("sid", "_source", "_dual", "_prior", "_u", "_base", "_t", "_at", "_fill"))


def _rates(df: DataFrame, cap: float) -> DataFrame:
    """Add ``rate``, its whole part, and the place of the record in the rounding order."""
    rate = F.least(F.lit(cap), F.col("_prior") * F.exp("_dual"))
    # A rate that is whole but for rounding errors counts as whole.
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    left = F.col("rate") - F.col("_base")
    return (df.withColumn("rate", F.when(F.isnan("_dual"), 0.0).otherwise(rate))
            .withColumn("_base", whole)
            .withColumn("_t", F.when(left > 1e-9, F.col("_u") / F.lit(2.0 ** 53) / left)))


def _edge_parts(open_rows: DataFrame, need: DataFrame) -> DataFrame:
    """(sid, _need, _low, _width, _start): the part of each source's order, from place _low on, in
    which its missing words end, and the words before it.

    Words are summed by source and part. A part that holds more than EDGE_ROWS rows, as equal
    records do, is parted again, so no part is large however many rows are alike.
    """
    edge = need.select("sid", "_need", F.lit(0.0).alias("_low"),
                       F.lit(2.0).alias("_width"), F.lit(0).cast("long").alias("_start"))
    for level in range(LEVELS):
        step = F.col("_width") / BLOCKS
        inside = open_rows.join(F.broadcast(edge), "sid").where(
            (F.col("_t") >= F.col("_low")) & ((F.col("_t") < F.col("_low") + F.col("_width"))
                                              | (F.lit(level == 0))))
        block = F.least(F.floor((F.col("_t") - F.col("_low")) / step), F.lit(BLOCKS - 1))
        sums = inside.groupBy("sid", block.alias("_block")).agg(
            F.sum("size").alias("_n"), F.count("*").alias("_rows"),
            *[F.first(c).alias(c) for c in ("_need", "_low", "_width", "_start")])
        upto = Window.partitionBy("sid").orderBy("_block").rowsBetween(
            Window.unboundedPreceding, 0)
        runs = sums.withColumn("_from", F.col("_start") + F.sum("_n").over(upto) - F.col("_n"))
        edge = written(runs.where("_from <= _need").groupBy("sid").agg(
            F.max(F.struct("_block", "_from", "_rows", "_need", "_low", "_width")).alias("e"))
            .select("sid", "e._need", (F.col("e._low") + F.col("e._block") * F.col("e._width")
                                       / BLOCKS).alias("_low"),
                    # The last part of all reaches as far as places do.
                    F.when((F.col("e._block") == BLOCKS - 1) & F.lit(level == 0), F.lit(1e300))
                    .otherwise(F.col("e._width") / BLOCKS).alias("_width"),
                    F.col("e._from").alias("_start"), "e._rows"), "mix_edges")
        if not edge.agg(F.max("_rows") > EDGE_ROWS).first()[0]:
            break
    return edge.drop("_rows")


def _fill_points(rated: DataFrame) -> DataFrame:
    """(sid, _at, _fill): records up to the first place, and at the second, take one more copy.

    Only the one part of each source's order in which the missing words end is put in order.
    """
    need = rated.groupBy("sid").agg((F.first("target") - F.sum(
        F.col("_base") * F.col("size"))).alias("_need"))
    open_rows = rated.filter("_t is not null and size > 0")
    edge = _edge_parts(open_rows, need)
    inside = Window.partitionBy("sid").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ranked = open_rows.join(F.broadcast(edge), "sid").where(
        (F.col("_t") >= F.col("_low")) & (F.col("_t") < F.col("_low") + F.col("_width"))).withColumn(
        "_sum", F.col("_start") + F.sum("size").over(inside))
    ends = ranked.groupBy("sid").agg(
        F.max(F.when(F.col("_sum") <= F.col("_need"), F.struct("_sum", "_t"))).alias("_last"),
        F.first("_start").alias("_start"), F.first("_low").alias("_low"),
        F.first("_need").alias("_need")).select(
            "sid", (F.col("_need") - F.coalesce("_last._sum", "_start")).alias("_gap"),
            F.coalesce(F.col("_last._t"), F.col("_low") - 1e-12).alias("_at"))
    # One later record per source, of the size nearest to what is still missing, fills up.
    off = F.abs(F.col("size") - F.col("_gap"))
    fill = (open_rows.join(F.broadcast(ends), "sid").filter((F.col("_t") > F.col("_at"))
                                               & (off < F.col("_gap")))
            .groupBy("sid").agg(F.min(F.struct(off.alias("off"), "_t"))["_t"].alias("_fill")))
    return ends.drop("_gap").join(F.broadcast(fill), "sid", "left")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_copies(docs).select("doc_id", "source", "size", "source_size", "target",
                                   "rate", "copies", "taken")
