"""From documents to shards: five stages, each written as a table before the next one reads it.

Language identification, near-duplicate removal, benchmark decontamination, mixing to target
weights, and sharding. Every stage works on all rows its predecessor kept. All but the last
return the columns of ``documents``; the last adds ``size``, ``text_crc32``, ``shard``, ``slot``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sieveguard
from sieveguard.llm import decontamination, language_id, mixing, sharding, simhash
from sieveguard.llm.common import table
from sieveguard.scratch import written

# Send the code of Python functions with each job, whatever folder the driver runs in.
cloudpickle.register_pickle_by_value(sieveguard)

SHARDS = 40


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null texts, texts without letters, and texts
    of which no learned language holds enough n-grams."""
    labelled = language_id.labelled_part(docs).select("doc_id", "text", "lang")
    return language_id.known_languages(docs, language_id.fit(labelled))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies (five-word shingles)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, up to a fifth of its words edited."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents, or leave them out, so that sources meet their share of words."""
    mixed = mixing.mix_copies(docs).filter("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")
    return mixed.select(*docs.columns, copies).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard by doc_id, and a gapless place in the shard."""
    placed = sharding.assign_shards(sharding.record_facts(docs), ["doc_id"], [1.0] * SHARDS)
    order = ["doc_id", "size", "text_crc32"]
    return sharding.number_slots(placed, order, order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# Trained filters, hashes and edit distances are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
