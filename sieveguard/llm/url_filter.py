"""URL rules looked up through a blocked Bloom filter and confirmed by an exact hash join.

The list holds canonical prefixes (host, path, verdict). A url asks for its host and every
parent domain, each with the beginnings of its path that are as long as some listed path.
All set bits of a key lie in one 512-bit block, so one block lookup answers a key. Keys that
pass meet the list itself in an equi-join, which removes the false positives; the longest
rule (host plus path, then host) that is left decides.

Nulls and texts without ``://`` have an empty host and path and no rule. Repeated urls are looked
up once, and repeated pages stay rows of their own. Long urls are read whole. Columns named like
an added one are refused. An empty list gives every page the default verdict; of rules equally
long, the one with the longer host holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import checked_rows, clear_names, table
from sieveguard.llm.registry import query

BITS_PER_KEY = 16
PROBES = 8                # bits set per key, one in each word of its block
WORDS = 8                 # 64-bit words of a block
MAX_PATH_LENGTHS = 4096   # distinct lengths of listed paths
BLOCK_BROADCAST = 200_000  # blocks (64 bytes each) that may be broadcast; beyond, shuffled

# The rules of the query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
         ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; query and fragment are left out."""
    clear_names(pages, ["host", "path"])
    rest = F.when(F.instr(url, "://") > 0,
                  F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    bare = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)\A([^/]*)", 1)
    return pages.withColumns({
        "host": F.coalesce(lower_ascii(host), F.lit("")),
        "path": F.coalesce(F.regexp_extract(bare, r"(?s)\A[^/]*(.*)\z", 1), F.lit(""))})


def key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("|"), path)


def probe_mask(h: Column, word: int) -> Column:
    """The bit that a key sets in one word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(
        F.xxhash64(h, F.lit(word)), F.lit(64)).cast("int"))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a filter over ``keys(h)``: one row per block that has a key."""
    return keys.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(
        *[F.bit_or(probe_mask(F.col("h"), i)).alias(f"w{i}") for i in range(PROBES)])


def possible(keyed: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Rows of ``keyed(h)`` whose key may be listed."""
    side = F.broadcast(bloom) if small else bloom
    hit = F.lit(True)
    for i in range(PROBES):
        hit = hit & (F.col(f"w{i}").bitwiseAND(probe_mask(F.col("h"), i)) != 0)
    joined = keyed.withColumn("block", F.pmod("h", F.lit(blocks))).join(side, "block")
    return joined.filter(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                block_broadcast: int = BLOCK_BROADCAST) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to pages with a ``url``.

    ``rules(host, path, verdict)`` may be long; its rows are counted to size the filter.
    Where several verdicts are listed for one prefix, ``block`` holds.
    """
    clear_names(pages, ["rule", "verdict", "rule_host", "rule_path", "_host", "_path", "_best", "_rest"])
    # A host without a path lists the whole host.
    listed = (rules.select(lower_ascii(F.col("host")).alias("rule_host"),
                           F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
              .filter("rule_host is not null and rule_host <> ''")
              .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")))
    total = listed.count()
    lengths = sorted(r[0] for r in checked_rows(
        listed.select(F.length("rule_path")).distinct(), MAX_PATH_LENGTHS, "path lengths"))
    blocks = max(1, -(-total * BITS_PER_KEY // (64 * WORDS)))
    bloom = blocked_bloom(listed.select(key_hash(F.col("rule_host"), F.col("rule_path"))
                                        .alias("h")), blocks)
    parts = with_parts(pages)
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    begins = F.transform(F.filter(sizes, lambda n: n <= F.length("path")),
                         lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(
        begins, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    # Urls are judged once for each host and path, without the pages' columns; a page then
    # takes its verdict from there.
    asked = (parts.select("host", "path").where("host <> ''").distinct()
             .withColumn("_k", F.explode(keys)).select(
                 "host", "path", "_k.rule_host", "_k.rule_path")
             .withColumn("h", key_hash(F.col("rule_host"), F.col("rule_path"))))
    left = possible(asked, bloom, blocks, blocks <= block_broadcast)
    found = left.join(listed, ["rule_host", "rule_path"])
    best = F.max(F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")))
    judged = found.groupBy("host", "path").agg(best.alias("_best")).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "_best")
    return parts.join(judged, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")),
                      "left").select(
        *parts.columns, F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
with cut as (
  select page_id, case when contains(url, '://')
    then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(regexp_extract(rest, '^([^?#]*)', 1), '^[^/]*((?s:.*))$', 1), '')
      as path from cut),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select page_id, host, path, max({'n': length(h) + length(p), 'r': h || p, 'v': v})
      filter (h is not null) as b
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by all)
select page_id, host, path, b.r as rule, coalesce(b.v, 'allow') as verdict from best"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
