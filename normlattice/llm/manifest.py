"""A Merkle manifest of a dataset, built and verified by supersteps over RDDs.

Rows are leaves; the leaves of a source make a tree, whose roots make one more tree. A node has up to
FANOUT children. Only digests and ids leave the scan of the texts. Leaves get their number in their
source by a range partitioning and sums over its partitions, so no task holds a source.

Vertices are named (tree, idx); tree is the number of the source, TOP that of the tree over sources.
Upward, each child sends its digest to its parent, and a parent with all its children hashes them and
sends its own digest on, one superstep a level, until a tree has one node left. Downward, each parent
sends its children the path above it, with their siblings. The last superstep doesn't send paths to
single leaves: the parent of up to FANOUT leaves holds them, checks each against the path and gives
its row. Each level is a written table, where lineage ends.

A path is bytes: for each level from the bottom the place of the child (a byte), the number of its
siblings (a byte) and their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import LOWER, UPPER, join_unique, materialise, small

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: The tree over the sources' roots.
TOP = -1
#: Every so many ids are tampered with, by their CRC-32.
TAMPERED = 5
DIGEST = 32
_LEVEL = "tree long, idx long, n long, kids binary, digest binary"
_PATH = "tree long, idx long, path binary"


# ---------------------------------------------------------------- leaves


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(id_, source, lang, n_chars, text) -> Column:
    """The digest of a row as binary."""
    return F.unhex(F.sha2(F.concat(*map(_field, (id_, source, lang, n_chars, text))).cast("binary"), 256))


def tampered(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """(doc_id, source, leaf, now, u) as a written table: the digest of each row, and that after tampering (null: the same).

    source is "" for null and "+" and the name else, which has the order of sources. u numbers the rows.
    """
    id_, source, lang, size, text = (F.col(c) for c in (id_col, source_col, lang_col, size_col, text_col))
    after = leaf_of(id_, source, lang, size, F.translate(text, UPPER, LOWER))
    key = F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))
    rows = docs.select(id_.alias("doc_id"), key.alias("source"), leaf_of(id_, source, lang, size, text).alias("leaf"), F.when(tampered(id_), after).alias("now"), F.monotonically_increasing_id().alias("u"))
    return materialise(rows, "leaves")


def numbered(rows: DataFrame, group: str | None, *order: str) -> DataFrame:
    """rows with idx, their place from 0 in their group, as a written table; nulls first.

    Rows are dealt by ranges of group and order, which must tell all rows apart, so a group of any
    size spreads over tasks. What is summed over partitions is a row for each group in each.
    """
    keys = [*([group] if group else []), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "dealt")
    head = ["_p", group] if group else ["_p"]
    parts = materialise(dealt.groupBy(*head).agg(F.min("_i").alias("_first"), F.count("*").alias("_n")), "parts")
    before = Window.partitionBy(*head[1:]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = dealt.join(small(materialise(parts, "parts")), head)
    return materialise(met.select(*rows.columns, (F.col("_i") - F.col("_first") + F.col("_before")).alias("idx")), "numbered")


# ---------------------------------------------------------------- upward


def digest_of(kids: bytes) -> bytes:
    """The digest of a node from its children's, which count as hexadecimal text."""
    return hashlib.sha256(kids.hex().encode()).digest()


def _complete(key: tuple[int, int], messages: Iterable[tuple[int, int, bytes]]) -> tuple:
    """A parent that has heard from all its children, or an error: none may be lost."""
    tree, idx = key
    got = sorted(messages)
    n = got[0][1]
    if [m[0] for m in got] != list(range(min(FANOUT, n - (idx << FANOUT_BITS)))):
        raise RuntimeError(f"node {key} has heard from {len(got)} children")
    kids = b"".join(m[2] for m in got)
    return tree, idx, -(-n >> FANOUT_BITS), kids, digest_of(kids)


def _table(spark: SparkSession, rows: RDD, schema: str, tag: str) -> DataFrame:
    return materialise(spark.createDataFrame(rows, schema, verifySchema=False), tag)


def _above(level: DataFrame) -> DataFrame:
    """The parents of a level's nodes (tree, idx, n, digest), where it has several, as a written table."""
    parts = level.rdd.getNumPartitions()
    sent = level.filter("n > 1").rdd.map(lambda r: ((r.tree, r.idx >> FANOUT_BITS), (r.idx & (FANOUT - 1), r.n, bytes(r.digest))))
    parents = sent.groupByKey(max(1, parts)).map(lambda kv: _complete(*kv))
    return _table(level.sparkSession, parents, _LEVEL, "level")


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """The levels over nodes (tree, idx, n, digest), each without the trees that are done below it."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(_above(levels[-1]))
        most = -(-most >> FANOUT_BITS)
    return levels


# ---------------------------------------------------------------- downward


def path_to(kids: bytes, i: int, above: bytes) -> bytes:
    others = kids[: i * DIGEST] + kids[(i + 1) * DIGEST :]
    return bytes((i, len(others) // DIGEST)) + others + above


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, digests of the siblings) of each level of a path."""
    at = 0
    while at < len(path):
        end = at + 2 + path[at + 1] * DIGEST
        yield path[at], path[at + 2 : end]
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that follows from a digest and its path."""
    for i, others in siblings(path):
        digest = digest_of(others[: i * DIGEST] + digest + others[i * DIGEST :])
    return digest


def proof_of(path: bytes) -> bytes:
    return digest_of(b"".join(others for _, others in siblings(path)))


def _sent(pair: tuple) -> Iterator[tuple]:
    """What a parent tells its children."""
    (tree, idx), (kids, path) = pair
    for i in range(len(kids) // DIGEST):
        yield tree, (idx << FANOUT_BITS) + i, path_to(kids, i, path)


def _keyed(df: DataFrame, value: str) -> RDD:
    return df.rdd.map(lambda r: ((r.tree, r.idx), bytes(r[value])))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, idx, path) of the nodes of levels[0], from the paths of the trees' last nodes (tree, path)."""
    spark, down = tops.sparkSession, None
    for level in reversed(levels):
        done = level.filter("n = 1").select("tree", "idx").join(tops, "tree").select("tree", "idx", "path")
        here = done if down is None else done.unionByName(down)
        if level is levels[0]:
            return materialise(here, "paths")
        parts = max(1, level.rdd.getNumPartitions())
        met = _keyed(level, "kids").join(_keyed(here, "path"), parts)
        down = _table(spark, met.flatMap(_sent), _PATH, "paths")
    raise ValueError("no level")


# ---------------------------------------------------------------- the operator


_RUN = "tree long, idx long, n long, leaves long, digest binary, rows array<struct<doc_id:{0},leaf:binary,now:binary>>"
_OUT = "doc_id {0}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _run(key: tuple[int, int], rows: Iterable[tuple]) -> tuple:
    """The leaves of one parent. A source's only leaf has none: it is what remains."""
    tree, idx = key
    got = sorted(rows, key=lambda r: r[0])
    count = got[0][1]
    if [r[0] for r in got] != list(range(min(FANOUT, count - (idx << FANOUT_BITS)))):
        raise RuntimeError(f"run {key} has {len(got)} leaves")
    digest = got[0][3] if count == 1 else digest_of(b"".join(r[3] for r in got))
    return tree, idx, -(-count >> FANOUT_BITS), count, digest, [r[2:] for r in got]


def _verified(run: Row, path: bytes, subroot: bytes, root: bytes) -> Iterator[tuple]:
    kids = b"".join(bytes(r.leaf) for r in run.rows)
    for i, r in enumerate(run.rows):
        own = path if run.leaves == 1 else path_to(kids, i, path)
        folded = fold(bytes(r.leaf if r.now is None else r.now), own)
        yield r.doc_id, bytes(r.leaf).hex(), subroot.hex(), root.hex(), proof_of(own).hex(), folded.hex(), folded == root


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    folded_root follows from the row as tampered with (every fifth id by CRC-32 has its text in small
    letters) and the siblings as they were. Nulls are marked in the leaf; a null source is a source of
    its own, before all others, and not the empty one. Leaves without a doc_id come first in their source;
    rows that share one stand in the order of their leaves; rows that repeat are leaves each. A null text
    stays null. Texts of any length are hashed whole, in the JVM. Empty input: empty result. Other
    columns of docs are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    leaf = leaves(docs, id_col, source_col, lang_col, size_col, text_col)
    sources = numbered(materialise(leaf.groupBy("source").agg(F.count("*").alias("n")), "sources"), None, "source")
    leaf = numbered(leaf, "source", "doc_id", "leaf", "u")
    # each leaf with the number of its source and the size of it
    counted = sources.select("source", F.col("idx").alias("tree"), F.col("n").alias("leaves"), "n")
    leaf = join_unique(leaf, counted, "source")

    parts = max(1, leaf.rdd.getNumPartitions())
    sent = leaf.select("tree", "idx", "leaves", "doc_id", "leaf", "now").rdd.map(lambda r: ((r.tree, r.idx >> FANOUT_BITS), (r.idx & (FANOUT - 1), r.leaves, r.doc_id, bytes(r.leaf), None if r.now is None else bytes(r.now))))
    runs = _table(spark, sent.groupByKey(parts).map(lambda kv: _run(*kv)), _RUN.format(kind), "runs")
    levels = ascend(runs.select("tree", "idx", "n", "digest"))
    done = levels[0].filter("n = 1")
    for level in levels[1:]:
        done = done.unionByName(level.filter("n = 1").select(*done.columns))
    subroots = materialise(done.select("tree", "digest"), "subroots")

    count = sources.count()
    top = ascend(materialise(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"), "top"))
    root = top[-1].first()
    empty = spark.createDataFrame([(TOP, b"")], "tree long, path binary")
    down = descend(top, empty).select(F.col("idx").alias("tree"), "path")
    tops = materialise(down.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree"), "tops")
    paths = descend(levels, tops.select("tree", "path"))

    seal = bytes(root.digest) if root else b""
    names = tops.drop("path").join(counted.select("tree", "n"), "tree")
    met = join_unique(runs.join(paths, ["tree", "idx"]), names, "tree")
    out = met.rdd.flatMap(lambda r: _verified(r, bytes(r.path), bytes(r.subroot), seal))
    return _table(spark, out, _OUT.format(kind), "manifest")


def _sql_levels(name: str, group: str, levels: int) -> str:
    """CTEs name0 .. of nodes (group, idx, n, h) and, with k, of the digests of a parent's children in a row."""
    step = """
{name}k{i} AS (
  SELECT {group}, idx // 16 AS idx, max(n) AS n, string_agg(h, '' ORDER BY idx) AS k FROM {name}{i} GROUP BY {group}, idx // 16
), {name}{j} AS (
  SELECT {group}, idx, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(k) ELSE k END AS h FROM {name}k{i}
),"""
    return "".join(step.format(name=name, group=group, i=i, j=i + 1) for i in range(levels))


def _sql_folds(source_levels: int, top_levels: int) -> str:
    """CTEs f0 .. that take each leaf up level by level: (idx, at, proof, x)."""
    out = ""
    for i in range(source_levels + top_levels):
        name, j = ("s", i) if i < source_levels else ("t", i - source_levels)
        idx = "f.rank" if i == source_levels else "f.idx"
        out += f"""
f{i + 1} AS (
  SELECT f.doc_id, f.source, f.rank, f.leaf, f.subroot, f.root, {idx} // 16 AS idx,
         CASE WHEN k.n > 1 THEN f.proof || k.k[1:64 * ({idx} % 16)] || k.k[64 * ({idx} % 16) + 65:] ELSE f.proof END AS proof,
         CASE WHEN k.n > 1 THEN sha256(k.k[1:64 * ({idx} % 16)] || f.x || k.k[64 * ({idx} % 16) + 65:]) ELSE f.x END AS x
  FROM f{i} f JOIN {name}k{j} k ON k.idx = {idx} // 16 {"AND k.source = f.source" if name == "s" else ""}
),"""
    return out.rstrip(",")


def oracle_sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """The query in SQL, for sources of at most 16 ** source_levels rows, and 16 ** top_levels sources."""
    return f"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), c AS (
  SELECT doc_id, coalesce('+' || source, '') AS source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % {TAMPERED} = 0 AS odd
  FROM documents, tab
), e AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN odd THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END, '-')) AS now
  FROM c
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS rank,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM e
), s0 AS (SELECT source, idx, n, leaf AS h FROM l),{_sql_levels("s", "source", source_levels)}
r AS (
  SELECT source, h, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS n FROM s{source_levels}
), t0 AS (SELECT 0 AS g, idx, n, h FROM r),{_sql_levels("t", "g", top_levels)}
f0 AS (
  SELECT l.doc_id, l.source, l.rank, l.leaf, r.h AS subroot, t{top_levels}.h AS root, l.idx, '' AS proof, l.now AS x
  FROM l JOIN r ON r.source = l.source, t{top_levels}
),{_sql_folds(source_levels, top_levels)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{source_levels + top_levels}
"""
