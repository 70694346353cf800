"""Audit of how much the sources of a language differ, by joint histograms of term counts.

A group is a language's documents of one source. Terms are counted in Arrow batches and added up by
(language, source, term); a term that enough of its language's documents have is kept. Kept terms are
dealt to bins of about BIN_TERMS, sources to blocks of about BLOCK_SOURCES. A task has one
bin and two blocks of sources, whatever a language's size, and tallies for each pair of sources how
often each combination of two counts occurs; a term that a source lacks is a zero there. Terms that no
source of the two blocks has are implied: they are what is missing of all kept terms. So the divergence
of a pair evaluates its function once for each combination, times the number of terms that have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import LOWER, UPPER, materialise, small

MIN_DOCS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
TOP = 10
#: Bytes of text whose terms are counted at once; a longer text is cut at the ends of terms.
SLICE_BYTES = 1 << 23
#: Terms and sources of one task's matrix of counts.
BIN_TERMS, BLOCK_SOURCES = 1 << 13, 32

#: Letters and all bytes beyond ASCII are parts of terms, capitals as small letters; other bytes are 32.
_TERM = bytes(
    b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b) in LOWER else 32 for b in range(256)
)
_LUT = np.frombuffer(_TERM, np.uint8)
_COUNT_NAMES = ["lang", "source", "term", "n", "docs"]
_COUNTS = "lang string, source string, term binary, n long, docs long"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some SLICE_BYTES of it at a time."""
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        while end < len(raw) and _LUT[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_TERM).split()
        at = end


def _tally(raws: list[bytes], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of the different terms of each group of documents."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    x = _LUT[np.frombuffer(b"".join(raws), np.uint8)]
    inside = x != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = (ends - sizes)[sizes > 0]
    first[starts] = inside[starts]
    # a token's length: of the kept bytes, those up to the next token's first
    kept = np.flatnonzero(first[inside])
    data = x[inside]
    offsets = np.append(kept, len(data)).astype(np.int32)
    doc = np.searchsorted(ends, np.flatnonzero(first), side="right")
    words = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    code, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    met, n = np.unique(doc * size + code, return_counts=True)
    both, back = np.unique(group[met // size] * size + met % size, return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, back, n)
    return words.dictionary.take(pa.array(both % size)), both // size, total, np.bincount(back, minlength=len(both))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows to partial counts."""
    held: list[tuple] = []
    size = 0

    def out(names: list[tuple], term: pa.Array, group: np.ndarray, n, docs) -> pa.RecordBatch:
        lang, source = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], _COUNT_NAMES)

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(dict.fromkeys((h[0], h[1]) for h in held))
        number = {g: i for i, g in enumerate(names)}
        yield out(names, *_tally([h[2] for h in held], np.array([number[h[0], h[1]] for h in held], np.int64)))

    for b in batches:
        for lang, source, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = x.as_py()
            if len(raw) > SLICE_BYTES:
                own: Counter = Counter()
                for part in _pieces(raw):
                    own.update(part)
                n = np.fromiter(own.values(), np.int64, len(own))
                yield out([(lang, source)], pa.array(list(own), pa.binary()), np.zeros(len(n), np.int64), n, np.ones(len(n), np.int64))
                continue
            if held and size + len(raw) > SLICE_BYTES:
                yield from flush()
                held, size = [], 0
            held.append((lang, source, raw))
            size += len(raw)
    if held:
        yield from flush()


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): counts of kept terms, and those of the whole language, as a written table.

    first marks one row of a language's term. rows: (lang, source, text as bytes).
    """
    parts = rows.mapInArrow(_counted, _COUNTS)
    counts = parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has a row for each source, whatever the number of documents
    own = Window.partitionBy("lang", "term")
    first = F.col("source") == F.min("source").over(own)
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(own).alias("total"), first.alias("first"), F.sum("docs").over(own).alias("docs"))
    return materialise(counts.filter(F.col("docs") >= min_docs).drop("docs"), "terms")


def _share(count: Column, n: Column, v: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (n + smoothing * v)), exactly; never divides by zero."""
    above = F.lit(scale).cast("decimal(12,0)") * (count + smoothing).cast("decimal(20,0)")
    below = F.greatest(n + smoothing * v, F.lit(1)).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sources(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n, blocks, bins, block) of each group, as a written table."""
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = materialise(groups.join(own, ["lang", "source"], "left").na.fill(0, ["n", "v"]), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"), F.count("*").alias("s"))
    langs = langs.select("lang", "lang_n", "v", F.ceil(F.col("s") / BLOCK_SOURCES).alias("blocks"), F.greatest(F.ceil(F.col("v") / BIN_TERMS), F.lit(1)).alias("bins"))
    out = groups.select("lang", "source", "n").join(small(materialise(langs, "langs")), "lang")
    return materialise(out.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "sources")


def _tiles(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, bin, i, j, block, source, term, n): rows of each task; a row without a term names a source in each bin."""
    named = sources.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    rows = kept.select("lang", "source", "term", "n").join(small(sources.select("lang", "source", "block", "blocks", "bins")), ["lang", "source"])
    rows = rows.select("lang", "source", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("bins")).alias("bin"), "term", "n")
    every = rows.unionByName(named).withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return every.select("lang", "bin", F.least("block", "peer").alias("i"), F.greatest("block", "peer").alias("j"), "block", "source", "term", "n")


def joint_counts(names: list[str], block: np.ndarray, who: np.ndarray, term: np.ndarray, n: np.ndarray) -> list[tuple]:
    """(a, b, counts in a, counts in b, terms) of pairs of a task's sources: of different blocks, or of its only one.

    names and block of each source; (who, term, n) of each count that isn't zero, by numbers of sources and terms.
    """
    values, value = np.unique(np.append(n, 0), return_inverse=True)
    # values are ascending and none is negative, so zero is the first
    grid = np.zeros((len(names), int(term.max(initial=-1)) + 1), np.int64)
    grid[who, term] = value[:-1]
    one = len(set(block.tolist())) == 1
    out = []
    order = sorted(range(len(names)), key=names.__getitem__)  # the same direction in every bin
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if one or block[a] != block[b]:
                pair, times = np.unique(grid[a] * len(values) + grid[b], return_counts=True)
                out.append((names[a], names[b], values[pair // len(values)], values[pair % len(values)], times))
    return out


def _joint(table: pa.Table) -> pa.Table:
    first = lambda c: table.column(c)[0].as_py()
    codes = lambda c: c.combine_chunks().dictionary_encode()
    sources, block = codes(table.column("source")), table.column("block").to_numpy()
    who, named = sources.indices.to_numpy(), np.zeros(len(sources.dictionary), np.int64)
    named[who] = block
    real = table.column("term").is_valid()
    terms, who = codes(table.column("term").filter(real)).indices.to_numpy(), who[real.to_numpy()]
    rows = joint_counts(sources.dictionary.to_pylist(), named, who, terms, table.column("n").filter(real).to_numpy())
    if first("i") != first("j") and len(set(named.tolist())) == 1:
        rows = []  # the other block has no source
    # a pair of sources has a row even if no term is in the bin
    size = [max(1, len(r[4])) for r in rows]
    cat = lambda k: np.concatenate([r[k] if len(r[4]) else np.zeros(1, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    name = lambda k: pa.array([r[k] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), size), pa.int64()))
    return pa.table({"lang": pa.array([first("lang")] * sum(size), pa.string()), "a": name(0), "b": name(1), "x": cat(2), "y": cat(3), "times": cat(4)})


def pair_values(kept: DataFrame, sources: DataFrame, smoothing: int = SMOOTHING, scale: int = SCALE) -> DataFrame:
    """(lang, source, item, value): both directions of each pair of a language's sources."""
    joint = _tiles(kept, sources).groupBy("lang", "bin", "i", "j").applyInArrow(_joint, "lang string, a string, b string, x long, y long, times long")
    joint = joint.groupBy("lang", "a", "b", "x", "y").agg(F.sum("times").alias("times"))
    side = lambda s: small(sources.select("lang", F.col("source").alias(s), F.col("n").alias(f"{s}_n"), *([F.col("v")] if s == "a" else [])))
    joint = joint.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    p, q = (_share(F.col(c), F.col(f"{s}_n"), F.col("v"), smoothing, scale) for c, s in (("x", "a"), ("y", "b")))
    sums = joint.groupBy("lang", "a", "b", "a_n", "b_n", "v").agg(F.sum(F.col("times") * _distance(p, q)).alias("value"), F.sum("times").alias("seen"))
    p, q = (_share(F.lit(0).cast("long"), F.col(f"{s}_n"), F.col("v"), smoothing, scale) for s in "ab")
    both = sums.select("lang", "a", "b", (F.col("value") + (F.col("v") - F.col("seen")) * _distance(p, q)).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return both.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def term_values(kept: DataFrame, sources: DataFrame, smoothing: int = SMOOTHING, scale: int = SCALE) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more of than its language."""
    rows = kept.join(small(sources.select("lang", "source", F.col("n").alias("own_n"), "v", "lang_n")), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("own_n"), F.col("v"), smoothing, scale), _share(F.col("total"), F.col("lang_n"), F.col("v"), smoothing, scale)
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return rows.select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group is from the other sources of its language, and by which terms.

    Part pair has all other sources, part term the first `top` terms of which the group has more than
    its language. Equal values rank by item, bytewise. Null text, lang and source count as empty, so
    rows without a lang are a language of their own; rows that repeat are documents each. A group without terms is compared as well;
    where a language keeps no term, pairs have value 0; a language with one source has no pair. Texts
    of any length are read whole, some SLICE_BYTES at a time. Empty input: empty result. Other
    columns of docs are ignored.
    """
    ship(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kept = kept_terms(rows, min_docs)
    sources = _sources(rows, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, sources, smoothing, scale).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, sources, smoothing, scale).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    part = lambda df, p: df.select("lang", "source", F.lit(p).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(ts), '{UPPER}', '{LOWER}') AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), l AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS ln, coalesce(sum(c.c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l ON l.lang = x.lang
  LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {SMOOTHING})) // (g.n + {SMOOTHING} * g.v) AS p,
         1 + ({SCALE}::HUGEINT * (k.c + {SMOOTHING})) // (g.ln + {SMOOTHING} * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
