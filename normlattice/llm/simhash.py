"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Two fingerprints that differ in at most 4 of 64 bits agree in at least 2 of 6 blocks. For each of
the 15 pairs of blocks the bits are reordered so that these blocks come first, which makes one trie
per pair; its nodes below the agreeing blocks (20 to 22 bits) are the units of work. A unit's trie
is joined with itself: node pairs descend together one bit at a time, differing bits accumulate and
a pair is pruned when they exceed the budget. Every pair of fingerprints within the budget shares a
unit in some trie, so no link is lost. A unit keeps links enough to span its components.

The same holds of the other bits of a unit: one with more than UNIT_ROWS fingerprints is split by
pairs of six blocks of these, which agree in 14 bits more, and once again, in 10 more. What is left
differs in 20 bits at most, so a worker holds at most 2 ** 20 fingerprints of a unit, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import set_join, url_filter
from .common import connected_components, fresh, join_unique, materialise, small, texts

SEED = 42
BUDGET = 4
SHINGLE = 4
#: (first bit from the top, width) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Bits at least that the fingerprints of a unit have in common.
AGREED = 20
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
#: Fingerprints in a unit before it is split by more blocks, and the widths of these blocks of what is left of the bits.
UNIT_ROWS = 8192
SPLITS = ((8, 8, 7, 7, 7, 7), (5, 5, 5, 5, 5, 5))
#: Node pairs that a task expands at once; more wait on a stack.
FRONTIER = 1 << 19


# ---------------------------------------------------------------- fingerprints


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without a word."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    k = min(width, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(a), 65280):
        part = b"".join([digest(joined[i:j], SEED) for i, j in zip(a[at : at + 65280], b[at : at + 65280], strict=True)])
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp), the latter two as signed longs. Null and wordless texts have fp 0."""
    src = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- the trie join


def _reorder(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fingerprints with the two blocks of their table moved to the top."""
    out = np.zeros_like(fp)
    for t, pair in enumerate(TABLES):
        if not (own := table == t).any():
            continue
        x, y = fp[own], np.zeros(int(own.sum()), np.uint64)
        for i in (*pair, *(i for i in range(len(BLOCKS)) if i not in pair)):
            first, wide = BLOCKS[i]
            part = (x >> np.uint64(64 - first - wide)) & np.uint64((1 << wide) - 1)
            y = (y << np.uint64(wide)) | part
        out[own] = y
    return out


def _links(keys: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget. keys: sorted within each node; pairs: (lo, hi, lo, hi) of nodes at depth."""
    stack = [(depth, *pairs, np.zeros(len(pairs[0]), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, a, b, c, e, err = stack.pop()
        if len(a) > FRONTIER:
            h = len(a) // 2
            stack += [(d, a[:h], b[:h], c[:h], e[:h], err[:h]), (d, a[h:], b[h:], c[h:], e[h:], err[h:])]
            continue
        same = a == c
        # two leaves meet: the remaining bits are compared at once
        leaf = ((b - a) == 1) & ((e - c) == 1)
        if leaf.any():
            i, j = a[leaf & ~same], c[leaf & ~same]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            yield i[near], j[near]
            a, b, c, e, err, same = a[~leaf], b[~leaf], c[~leaf], e[~leaf], err[~leaf], same[~leaf]
        if not len(a):
            continue
        if d not in ones:
            ones[d] = np.append(0, np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1))).astype(np.int64)
        s = ones[d]
        m, n = b - (s[b] - s[a]), e - (s[e] - s[c])
        cross = ~same
        out = [
            (a, m, c, n, err),
            (m, b, n, e, err),
            (a, m, n, e, err + np.int8(1)),
            (m[cross], b[cross], c[cross], n[cross], err[cross] + np.int8(1)),
        ]
        p, q, r, t, err = (np.concatenate(x) for x in zip(*out, strict=True))
        ok = (p < q) & (r < t) & (err <= budget) & ~((p == r) & (q - p == 1))
        if ok.any():
            stack.append((d + 1, p[ok], q[ok], r[ok], t[ok], err[ok]))


def _spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item of its component."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def join_units(unit: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of each unit. Rows of one unit stand together; its table is its lowest 4 bits."""
    keys = _reorder(fp, (unit & 15).astype(np.int64))
    group = np.cumsum(np.append(True, unit[1:] != unit[:-1])) - 1
    order = np.lexsort((keys, group))
    keys, fp, group = keys[order], fp[order], group[order]
    lo = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    hi = np.append(lo[1:], len(keys))
    ok = hi - lo > 1
    lo, hi = lo[ok], hi[ok]
    root = _spanning(len(keys), _links(keys, (lo, hi, lo, hi), AGREED, budget))
    far = fp[root] != fp
    return fp[root][far], fp[far]


def _run_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b = join_units(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        unit, fp = (batch.column(i).to_numpy() for i in range(2))
        fp = fp.view(np.uint64)
        last = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if unit[0] != unit[-1] else 0
        if last:
            yield emit([*held, (unit[:last], fp[:last])])
            held = []
        elif held and held[0][0][-1] != unit[0]:
            yield emit(held)
            held = []
        held.append((unit[last:], fp[last:]))
    if held:
        yield emit(held)


def _tables(bits: Column, widths: tuple[int, ...]) -> Column:
    """A struct (t, key, rest) for each two of the blocks of these widths: their bits, and the others'."""
    ends = np.cumsum(widths)
    at = [int(ends[-1] - e) for e in ends]
    block = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, widths, strict=True)]

    def joined(which) -> Column:
        out = F.lit(0).cast("long")
        for i in which:
            out = F.shiftleft(out, widths[i]).bitwiseOR(block[i])
        return out

    others = lambda pair: [i for i in range(len(widths)) if i not in pair]
    return F.array(*(F.struct(F.lit(t).cast("long").alias("t"), joined(p).alias("key"), joined(others(p)).alias("rest")) for t, p in enumerate(combinations(range(len(widths)), 2))))


def near_links(prints: DataFrame, budget: int = BUDGET, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(a, b): links that span the components of the distinct prints (fp) within the budget."""
    rows = prints.select("fp", F.inline(_tables(F.col("fp"), tuple(w for _, w in BLOCKS))))
    rows = rows.select("fp", "rest", F.shiftleft(F.xxhash64("t", "key"), 4).bitwiseOR(F.col("t")).alias("unit"))
    parts = []
    for widths in SPLITS:
        crowded = materialise(rows.groupBy("unit").count().filter(F.col("count") > unit_rows).select("unit"), "crowded")
        if crowded.isEmpty():
            break
        parts.append(rows.join(small(crowded), "unit", "left_anti"))
        own = F.shiftleft(F.xxhash64("unit", "t", "key"), 4).bitwiseOR(F.col("unit").bitwiseAND(F.lit(15)))
        rows = rows.join(small(crowded), "unit").select("fp", "unit", F.inline(_tables(F.col("rest"), widths))).select("fp", "rest", own.alias("unit"))
    for part in parts:
        rows = rows.unionByName(part)
    rows = rows.select("unit", "fp")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_run_units, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs: (doc_id, text_hash, fp, component_id, root).

    component_id is the smallest doc_id that links of at most `budget` differing bits reach, null
    only where no row of the component has a doc_id; root is one fingerprint of the component.
    Texts without a word (null, empty, blank) have fingerprint 0 and link like any other. Repeated
    rows stay repeated. Empty input: empty result. Other columns of docs are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "prints")
    kinds = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "kinds")
    roots = connected_components(near_links(kinds.select("fp"), budget)).toDF("fp", "root")
    rooted = materialise(kinds.join(small(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # n: the prints of a component, then the rows of a print
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = join_unique(rooted.withColumnRenamed("n", "rows"), materialise(least, "least"), "root").withColumnRenamed("rows", "n")
    named = materialise(named.select("fp", "root", "component_id", "n"), "named-prints")
    return join_unique(rows, named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = set_join.SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: (doc_id, text_hash, root); texts of a component share root.

    Links are similarities of 0.8 or more of the sets of word shingles. Fingerprints of these sets
    are joined by the trie; an exact check of their groups and of all other pairs follows, since
    texts at that similarity differ in some ten of 64 bits. Texts without a word (null, empty,
    blank) are alike. Repeated rows stay repeated. Empty input: empty result. Other columns of docs
    are ignored.
    """
    rows = materialise(set_join.keyed(docs, id_col, text_col, width), "keys")
    kinds = rows.groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    kinds = materialise(kinds, "kinds")
    groups = connected_components(near_links(kinds.select("fp").distinct(), budget)).toDF("fp", "print_root")
    kinds = kinds.join(small(groups), "fp", "left").select("key", "size", "text_hash", F.coalesce("print_root", "fp").alias("group"))
    links = set_join.similar_links(docs, kinds, text_col, width)
    roots = materialise(connected_components(links).toDF("key", "root"), "roots")
    named = rows.select("doc_id", "text_hash", "key").join(small(roots), "key", "left")
    return named.select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, width: int = SHINGLE, exact: bool = False) -> DataFrame:
    """docs without its near-duplicates: of each component the row with the smallest doc_id stays.

    Components are those of near_duplicates, or of similar_texts if exact. Rows without a doc_id
    come last; of rows that share the doc_id the smallest text hash stays, and of rows that repeat
    both, one. No text is shuffled but those of rows that repeat both, if there are any. Null,
    empty and blank texts are alike. Empty input: empty result. All columns of docs are kept.
    """
    named = similar_texts(docs, id_col, text_col, width, budget) if exact else near_duplicates(docs, id_col, text_col, budget, width)
    named = materialise(named.select("doc_id", "text_hash", "root"), "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))).alias("k"), F.count("*").alias("n"))
    pre = fresh(docs, "_one_")
    id_, h = f"{pre}id", f"{pre}h"
    same = F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("text_hash") == F.col("k.h"))
    gone = named.join(small(first.filter("n > 1")), "root").filter(~same)
    gone = materialise(gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(f"{h}h")).distinct(), "gone")
    hashed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    kept = url_filter.without(hashed, gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(h) == F.col(f"{h}h")), h, f"{h}h")
    again = named.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(f"{h}h"))
    again = materialise(again, "again")
    if not again.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(h) == F.col(f"{h}h"))
        once = kept.join(small(again), same, "left_semi").dropDuplicates([id_col, h])
        kept = url_filter.without(kept, again, same, h, f"{h}h").unionByName(once)
    return kept.select(*docs.columns)
