"""Weighted rendezvous hashing of stable keys over shards, with gapless positions.

Every record draws one number per shard from (key, shard) alone and goes to the shard with
the smallest ``-ln(u) / weight``. A further shard only adds one more draw, so it takes
records into itself and moves none between the others.

Nulls: a null key is a key like any other; a null text counts no bytes and has checksum 0.
Repeated rows share key and shard and get different slots. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveguard.llm.common import clear_names, table
from sieveguard.llm.registry import query
from sieveguard.scratch import written

SLOT_BLOCKS = 256   # parts of a shard that are numbered side by side
OVERHEAD = 16       # bytes counted for a record besides its text


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """Exponential draw of one shard for one hashed key; the smallest wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
    return -F.log(u) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of a hashed key (a long) under the given positive weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shares = F.array(*[F.lit(float(w)) for w in weights])
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(draw(key, s, F.element_at(shares, s + 1)).alias("d"), s.alias("s")))
    return F.array_min(draws)["s"]


def assign_shards(df: DataFrame, keys: list[str], weights: list[float],
                  added: float | None = None) -> DataFrame:
    """Add ``shard`` and, with the weight of one more shard, ``grown_shard``."""
    clear_names(df, ["shard", "grown_shard", "_key"])
    # Nulls are skipped by the hash, so their place goes into it as well.
    parts = [p for k in keys for p in (F.col(k).isNull(), F.col(k))]
    out = df.withColumn("_key", F.xxhash64(*parts))
    out = out.withColumn("shard", rendezvous(F.col("_key"), weights))
    if added is not None:
        last = len(weights)
        kept = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
        out = out.withColumn("grown_shard", F.when(
            draw(F.col("_key"), F.lit(last), F.lit(float(added)))
            < draw(F.col("_key"), F.col("shard"), kept), F.lit(last)).otherwise(F.col("shard")))
    return out.drop("_key")


def number_slots(df: DataFrame, spread: list[str], order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard.

    A shard is dealt into blocks by a hash of the ``spread`` columns. Blocks are counted,
    the counts summed over at most SLOT_BLOCKS rows per shard, and rows numbered inside
    their block, so no task sees a whole shard. ``df`` is read twice.
    """
    clear_names(df, ["slot", "_block", "_offset"])
    cut = df.withColumn("_block", F.pmod(F.xxhash64(F.lit("slot"), *spread),
                                         F.lit(SLOT_BLOCKS)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (cut.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
               .select("shard", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                       .alias("_offset")))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*order))
    return (cut.withColumn("_rn", inside).join(offsets, ["shard", "_block"])
            .withColumn("slot", (F.col("_offset") + F.col("_rn") - 1).cast("long"))
            .drop("_rn", "_block", "_offset"))


def record_facts(docs: DataFrame) -> DataFrame:
    """Add ``size`` (UTF-8 bytes plus OVERHEAD) and ``text_crc32`` of each document."""
    clear_names(docs, ["size", "text_crc32"])
    return docs.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD,
        "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))})


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    facts = written(assign_shards(record_facts(docs).drop("text"), ["doc_id"],
                                  [1.0] * 40, added=1.0), "shards")
    slots = number_slots(facts, ["doc_id", "size", "text_crc32"],
                         ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        "slot", "grown_shard")
