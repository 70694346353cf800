"""Quality rules with a verdict on each host, in DataFrame functions only.

Every document gets counts and a base rule. The base rule's failures are then summed by host, each
host's failure rate is shrunk towards the mean of all hosts by a beta prior fitted to the hosts
(method of moments), and a host whose shrunk rate exceeds HOST_LIMIT loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, fresh, materialise

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected where its shrunk share of failing documents is above this.
HOST_LIMIT = 0.8
#: Rejected hosts that are broadcast; more are joined by host and salt.
MAX_BROADCAST_HOSTS = 200_000
SALTS = 64
#: Bounds of the prior's strength, in documents.
STRENGTH = (2.0, 1e6)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, SPACE_CLASS + "+"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rest(c: Column, by: int) -> Column:
    return F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))


def window_hashes(ws: Column) -> Column:
    """A hash of each window of 8 words, from hashes of 1, 2 and 4 words."""

    def twice(by: int):
        return lambda h: F.zip_with(h, _rest(h, by), lambda a, b: F.xxhash64(a, b))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        hashed = _let(hashed, twice(by))
    return _let(hashed, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, where some do."""
    at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        twin = F.filter(s, lambda e, j: (e.h == F.get(s, j + 1).h).eqNullSafe(True) | (F.when(j > 0, F.get(s, j - 1).h) == e.h).eqNullSafe(True))
        return F.sort_array(F.transform(twin, lambda e: e.i))

    def total(p: Column) -> Column:
        steps = F.zip_with(p, _rest(p, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    return _let(_let(F.sort_array(at), starts), total)


def repeat_words(ws: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first time included."""

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(_let(window_hashes(ws), count))


def features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts, each a long, and base_failed. A null text counts as empty."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    f = f"{prefix}features"
    out = docs.withColumn(f, _let(words(t), of))
    bad = (F.col(f"{f}.n_words") < MIN_WORDS) | (100 * F.col(f"{f}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{f}.n_words"))
    return out.withColumn(f"{prefix}base_failed", bad)


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, n_failed, shrunk): each host's share of failing documents, shrunk. Null hosts are left out."""
    tally = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    tally = tally.agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    m, v = tally.agg(F.avg(rate), F.var_samp(rate)).first()
    m = m or 0.0
    strength = max(STRENGTH[0], min(STRENGTH[1], m * (1 - m) / v - 1 if v else STRENGTH[1]))
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return tally.withColumn("shrunk", shrunk)


def rejected_hosts(judged: DataFrame, host: str, failed: str) -> DataFrame:
    return host_rates(judged, host, failed).filter(F.col("shrunk") > HOST_LIMIT).select("host")


def _join_hosts(rows: DataFrame, host: str, bad: DataFrame, how: str) -> DataFrame:
    """rows joined with hosts (host first in bad) without a task for each host.

    The hosts are counted: few are broadcast, many repeated for each salt that a host's rows are dealt to.
    """
    bad = materialise(bad, "hosts")
    name = bad.columns[0]
    same = F.col(host) == F.col(name)
    if bad.count() <= MAX_BROADCAST_HOSTS:
        return rows.join(F.broadcast(bad), same, how)
    salt = fresh(rows, "_salt_")
    rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    bad = bad.withColumn(f"{salt}b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(bad, same & (F.col(salt) == F.col(f"{salt}b")), how).drop(salt, f"{salt}b")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: (doc_id, the counts, base_failed, kept, host_rate).

    host_rate is the shrunk share of the host's documents that fail. kept is false where the base
    rule fails or the host is rejected; a document without a host has no rate and depends on the
    base rule alone. A null text has no word. Repeated rows count each. Empty input: empty result.
    Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = features(rows).select("doc_id", "host", "features.*", "base_failed")
    rows = materialise(rows, "judged")
    rates = host_rates(rows, "host", "base_failed").select(F.col("host").alias("rated_host"), "shrunk")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("shrunk") > HOST_LIMIT, F.lit(False))
    out = _join_hosts(rows, "host", rates, "left")
    return out.select("doc_id", *FEATURES, "base_failed", kept.alias("kept"), F.round("shrunk", 6).alias("host_rate"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without the documents that the rules reject, by the rule of judge().

    Nulls and repeated rows are treated as there. Empty input: empty result.
    """
    pre = fresh(docs, "_rule_")
    rows = materialise(features(docs, text_col, pre).drop(f"{pre}features"), "judged")
    bad = rejected_hosts(rows, host_col, f"{pre}base_failed").withColumnRenamed("host", f"{pre}host")
    kept = rows.filter(~F.col(f"{pre}base_failed"))
    return _join_hosts(kept, host_col, bad, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twin AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twin) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f
), host AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM b WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM host
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(2.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM m
), rate AS (
  SELECT source, (k + m * s) / (n + s) AS r FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r <= 0.8, TRUE) AS kept, round(r, 6) AS host_rate
FROM b LEFT JOIN rate ON rate.source = b.source
"""
