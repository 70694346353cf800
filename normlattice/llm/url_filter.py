"""URL filters in DataFrame functions only.

Host and path rules decide first, the longest that fits. Other URLs are looked up in a list of
canonical URLs: a blocked Bloom filter (one 64-bit word a block, BITS bits a URL in it) passes
possible hits on to an exact hash join, which removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, ascii_lower, fresh, materialise

#: Bits that a listed URL sets in its block.
BITS = 4
#: Listed URLs for each block of 64 bits.
PER_BLOCK = 4
#: Blocks that are broadcast; a filter with more is joined by a shuffle.
MAX_BROADCAST_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """verdict for URLs of the host and its subdomains whose path starts with the rule's: text is host + path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Without scheme, port 80 or 443, www., fragment, tracking parameters and closing slashes; null for no URL."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    left = F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)") & (x != ""))
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    args = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(left), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, args))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null where none does.

    Each suffix of the host is looked up in a map of the rules, so the cost of a row does not grow
    with the number of rules, which are given in code and so are few. Of equally long rules that of
    the longer host wins.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    none = F.lit(None).cast("struct<len:int,hosts:int,rule:string,verdict:string>")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = [
        F.struct(F.lit(h), F.array(*(F.struct(F.lit(r.path).alias("path"), F.lit(len(r.text)).alias("len"), F.lit(len(h)).alias("hosts"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in rs)))
        for h, rs in by_host.items()
    ]
    table = F.map_from_entries(F.array(*entry))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<path:string,len:int,hosts:int,rule:string,verdict:string>>"))))
    found = F.filter(found, lambda r: F.startswith(path, r.path))
    best = F.array_max(F.transform(found, lambda r: F.struct(r.len.alias("len"), r.hosts.alias("hosts"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    best = F.coalesce(best, none)
    return F.struct(best.rule.alias("rule"), best.verdict.alias("verdict"))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def mask_of(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys, a power of two."""
    return 1 << max(4, (max(1, n) // PER_BLOCK).bit_length())


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits): the filter, one row for each block that has a bit."""
    rows = listed.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("mask"))
    return rows.groupBy("block").agg(F.bit_or("mask").alias("bits"))


def _sifted(rows: DataFrame, listed: DataFrame, key: str, listed_key: str, n: int) -> tuple[DataFrame, DataFrame] | None:
    """rows whose key the Bloom filter of n listed keys may have, and the others; None if the filter is too large to broadcast."""
    blocks = blocks_for(n)
    if blocks > MAX_BROADCAST_BLOCKS:
        return None
    block, bits = fresh(rows, "_block"), fresh(rows, "_bits")
    mask = mask_of(F.col(key))
    asked = rows.withColumn(block, block_of(F.col(key), blocks))
    asked = asked.join(F.broadcast(bloom(listed, listed_key, blocks).toDF(block, bits)), block, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
    return asked.filter(maybe).drop(block, bits), asked.filter(~maybe).drop(block, bits)


def without(rows: DataFrame, gone: DataFrame, same: Column, key: str, gone_key: str) -> DataFrame:
    """rows without those that go. A longer list than a broadcast holds is met by what passes its Bloom filter alone."""
    n = gone.count()
    if n <= MAX_BROADCAST:
        return rows.join(F.broadcast(gone), same, "left_anti")
    sifted = _sifted(rows, gone, key, gone_key, n)
    if sifted is None:
        return rows.join(gone, same, "left_anti")
    return sifted[1].unionByName(sifted[0].join(gone, same, "left_anti"))


def matched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a written table on key. Of a longer one than a broadcast holds only rows that pass its Bloom filter are shuffled."""
    n = table.count()
    if n <= MAX_BROADCAST:
        return rows.join(F.broadcast(table), key)
    sifted = _sifted(rows, table, key, key, n)
    return (rows if sifted is None else sifted[0]).join(table, key)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_verdict: str = "block") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict).

    listed has a column url; its canonical form is what counts, nulls and repeats do not. A page
    without a rule gets listed_verdict if its canonical URL is listed, else the other verdict. A
    null url or one without :// has an empty host and path and is allowed. Repeated rows stay. Empty
    input: empty result. Other columns of pages are ignored.
    """
    other = {"block": "allow", "allow": "block"}[listed_verdict]
    keys = materialise(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct(), "listed")
    n = keys.count()
    blocks = blocks_for(n)
    bits = materialise(bloom(keys, "key", blocks), "bloom")
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    asked = F.when(F.col("fit.rule").isNull(), F.col("key"))
    rows = rows.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), asked.alias("key"))
    if blocks > MAX_BROADCAST_BLOCKS:
        # pages are read once; those that ask nothing are kept aside, so that no null gathers them in one task
        rows = materialise(rows, "asked")
        quiet = rows.filter("key is null").withColumn("probe", F.lit(None).cast("string"))
        rows = _probed(rows.filter("key is not null"), bits, blocks).unionByName(quiet)
    else:
        rows = _probed(rows, F.broadcast(bits), blocks)
    verdict = F.coalesce("ruled", F.when(F.col("hit"), listed_verdict).when(F.col("key").isNull(), "allow").otherwise(other))
    hits = keys.select(F.col("key").alias("probe"), F.lit(True).alias("hit"))
    if n <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(hits), "probe", "left")
    else:
        rows = materialise(rows, "probed")
        quiet = rows.filter("probe is null").withColumn("hit", F.lit(None).cast("boolean"))
        rows = rows.filter("probe is not null").join(hits, "probe", "left").unionByName(quiet)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _probed(rows: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """rows with probe: the key where the filter may have it, else null. Only those go on to the exact join."""
    key = F.col("key")
    rows = rows.withColumn("block", block_of(key, blocks)).withColumn("mask", mask_of(key)).join(bits, "block", "left")
    maybe = key.isNotNull() & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return rows.withColumn("probe", F.when(maybe, key)).drop("block", "mask", "bits")


def oracle_sql(rules: list[Rule], listing: str, share: str) -> str:
    """DuckDB SQL of judge(pages, pages whose host matches listing and whose url's MD5 starts below share, rules)."""
    table = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return rf"""
WITH rules(rule, h, p, v) AS (VALUES {table}),
pg AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS args
  FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key
  FROM pg
), listed AS (
  SELECT DISTINCT key FROM c WHERE regexp_matches(host, '{listing}') AND md5(url) < '{share}' AND key IS NOT NULL
), fit AS (
  SELECT page_id, url, rule, v, row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC, length(h) DESC) AS n
  FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT c.page_id, host, path, rule,
       coalesce(v, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN (SELECT * FROM fit WHERE n = 1) f ON f.page_id = c.page_id AND f.url = c.url
LEFT JOIN listed ON listed.key = c.key
"""
