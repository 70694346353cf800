"""Exact substring dedup: bytes covered by a string of LENGTH bytes that also starts earlier.

A suffix array of the whole corpus fits no machine, so starts are first dealt to shards that hold
all copies of what they start:

1. Anchors. The canonical anchor of a string of LENGTH bytes is its GRAM-byte gram with the least
   hash (the first of equals), which depends on the string alone. Consecutive starts with the same
   anchor make a segment, so a text of any length has some forty starts to a segment and equal
   strings lie in segments of equal anchors.
2. Repeated segments collapse (first within a batch, so that a popular passage sends a row for each
   batch at most): all but the earliest are repeats throughout. Anchors with a single segment left
   are done. The earliest of each segment goes on where its anchor has others.
3. Suffix arrays. The bytes of these segments, grouped by anchor into shards of at most SHARD_BYTES,
   get a suffix array by induced sorting and permuted common prefixes; runs of starts whose common
   prefix is at least LENGTH are copies of one string, of which the earliest stays.
   Anchors with many segments are dealt to shards by salt; the strings that stay in these meet
   once more by a 128-bit hash.

Only ids and offsets are shuffled by anchor. Texts are shuffled by document, twice: to cut segments
from those with any repeated anchor, and to apply the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .sais import permuted_lcp_at_least, suffix_array

LENGTH = 100
GRAM = 32
#: Grams in a string of LENGTH bytes.
GRAMS = LENGTH - GRAM + 1
#: Starts that are hashed at once.
BLOCK = 1 << 20
#: Rows of segments that are combined at once.
COMBINE_ROWS = 1 << 20
#: An anchor with so many segments in one combined batch is dealt by segment: its window gets fewer rows from each batch, and a sign.
HOT_SEGMENTS = 16
#: An anchor with so many segments left is dealt to shards by salt.
HOT_ROWS = 4096
SALTS = 1024
SHARD_BYTES = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- anchors


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h, width, base = x.astype(np.uint64), 1, _M1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        h = (h ^ (h >> np.uint64(32))) * _M2
        return h ^ (h >> np.uint64(29))


def segments(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, segment's hash, first start, starts) of a text's segments, in order, BLOCK starts at a time."""
    import xxhash

    n = len(raw) - LENGTH + 1
    if n <= 0:
        return
    x = np.frombuffer(raw, np.uint8)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        h = _gram_hashes(x[at : at + m + LENGTH - 1])
        key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: len(key) - (GRAMS - width)], key[GRAMS - width :])
        where = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        start, count = first + at, np.diff(np.append(first, m))
        own = [digest(raw[a:b]) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
        yield h[where[first]].view(np.int64), np.array(own, np.uint64).view(np.int64), start, count


ROW = "kind byte, pkey long, anchor long, seg long, ord long, tie long, start long, n long"
_ROW_TYPES = [pa.int8(), *[pa.int64()] * 7]
_ROW_NAMES = ["kind", "pkey", "anchor", "seg", "ord", "tie", "start", "n"]
#: Kinds of rows: of an anchor's partition; of a hot anchor, by segment; a repeat within its batch; a sign that an anchor is hot.
PLAIN, HOT, REPEAT, SIGN = 0, 1, 2, 3


def _runs(order: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ord, tie, start, n) with adjoining stretches of one document in one."""
    if not len(start):
        return order, tie, start, n
    at = np.lexsort((start, tie, order))
    order, tie, start, n = order[at], tie[at], start[at], n[at]
    new = np.flatnonzero(np.append(True, (order[1:] != order[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    return order[new], tie[new], start[new], np.add.reduceat(n, new)


def _combine(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a batch, repeated segments and hot anchors marked."""
    anchor, seg, order, tie, start, n = cols
    at = np.lexsort((start, tie, order, seg, anchor))
    anchor, seg, order, tie, start, n = (c[at] for c in (anchor, seg, order, tie, start, n))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_seg = new_anchor | np.append(True, seg[1:] != seg[:-1])
    group = np.cumsum(new_anchor) - 1
    many = np.bincount(group, weights=new_seg)[group] >= HOT_SEGMENTS
    kind = np.where(~new_seg, REPEAT, np.where(many, HOT, PLAIN)).astype(np.int8)
    spread = (seg ^ (anchor << np.int64(1))) if len(seg) else seg
    pkey = np.where(kind == PLAIN, anchor, spread)
    sign = new_anchor & many
    again = kind == REPEAT
    runs = _runs(order[again], tie[again], start[again], n[again])
    # of repeats only the place counts from here on: adjoining ones are one row
    none = np.zeros(len(runs[0]), np.int64)
    rest = ~again
    out = [np.concatenate([c[rest], c[sign], r]) for c, r in zip((anchor, seg, order, tie, start, n), (none, none, *runs), strict=True)]
    kind = np.concatenate([kind[rest], np.full(int(sign.sum()), SIGN, np.int8), np.full(len(none), REPEAT, np.int8)])
    pkey = np.concatenate([pkey[rest], anchor[sign], runs[0] * 1_000_003 + runs[2]])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([kind, pkey, *out], _ROW_TYPES, strict=True)], _ROW_NAMES)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        for order, tie, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            for anchor, seg, start, n in segments(raw.as_py()):
                held.append([anchor, seg, np.full(len(n), order), np.full(len(n), tie), start, n])
                rows += len(n)
                if rows >= COMBINE_ROWS:
                    yield _combine([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, rows = [], 0
    if held:
        yield _combine([np.concatenate(c) for c in zip(*held, strict=True)])


# ---------------------------------------------------------------- shards


def shard_repeats(strings: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, earliest) of each start of a whole LENGTH in the strings.

    rank orders the strings' places in the corpus; earliest is false where the LENGTH bytes from
    there also start at a place of lower rank, or earlier in the same string.
    """
    text = b"\0".join(strings)
    sizes = np.array([len(x) for x in strings], np.int64)
    first = np.append(0, np.cumsum(sizes + 1)[:-1])
    own = np.repeat(np.arange(len(strings)), sizes + 1)[: len(text)]
    offset = np.arange(len(text)) - first[own]
    left = sizes[own] - offset  # the joint has 0 left
    symbols = np.where(left > 0, np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    sa = suffix_array(symbols, 257)
    whole = left >= LENGTH
    same = permuted_lcp_at_least(text, sa, LENGTH) & whole
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    same &= (before >= 0) & whole[before]
    at = sa[whole[sa]]
    run = np.flatnonzero(~same[at])
    place = rank[own[at]] * (int(sizes.max(initial=0)) + 1) + offset[at]
    best = np.minimum.reduceat(place, run) if len(at) else place
    earliest = place == np.repeat(best, np.diff(np.append(run, len(at))))
    return own[at], offset[at], earliest


COVER = "ord long, tie long, start long, n long, hi long, lo long"
_COVER_NAMES = ["ord", "tie", "start", "n", "hi", "lo"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard key): (skey, hot, ord, tie, start, bytes). Gives covered runs of starts (hi null), and a
    hash of each string that stays in a hot anchor's shard."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(rows)), key=lambda i: rows[i][2:5])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        own, offset, earliest = shard_repeats([r[5] for r in rows], rank)
        o, t, s, hot = (np.array([r[i] for r in rows]) for i in (2, 3, 4, 1))
        i, off = own[~earliest], offset[~earliest]
        by = np.lexsort((off, i))
        i, off = i[by], off[by]
        new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (off[1:] != off[:-1] + 1))) if len(i) else np.zeros(0, np.int64)
        run = np.diff(np.append(new, len(i)))
        yield _cover(o[i[new]], t[i[new]], s[i[new]] + off[new], run, None)
        stay = earliest & hot[own].astype(bool)
        if stay.any():
            import xxhash

            i, off = own[stay], offset[stay]
            raw = b"".join([xxhash.xxh3_128_digest(rows[a][5][b : b + LENGTH]) for a, b in zip(i.tolist(), off.tolist(), strict=True)])
            yield _cover(o[i], t[i], s[i] + off, np.ones(len(i), np.int64), np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2))

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            # shards of whole keys; a hot key is cut anywhere, since its strings meet again
            if held and (size >= SHARD_BYTES and (row[0] != held[-1][0] or row[1])):
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) + 1
    if held:
        yield from flush(held)


def _cover(o, t, s, n, hashes: np.ndarray | None) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int64()) for c in (o, t, s, n)]
    cols += [pa.nulls(len(o), pa.int64())] * 2 if hashes is None else [pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
    return pa.RecordBatch.from_arrays(cols, _COVER_NAMES)


# ---------------------------------------------------------------- the operator


def covered(raw: bytes, starts: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, from runs of covered starts."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts, counts, strict=True)):
        e = min(len(raw), s + n + LENGTH - 1)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def repeated_starts(rows: DataFrame) -> DataFrame:
    """(ord, tie, start, n): runs of starts whose LENGTH bytes also start earlier. rows: (ord, tie, raw), one for each document."""
    anchors = rows.mapInArrow(_anchor_rows, ROW)
    part = Window.partitionBy("pkey", "split")
    along = part.orderBy("seg", "ord", "tie", "start")
    seen = anchors.withColumn("split", F.when(F.col("kind").isin(HOT, REPEAT), F.col("kind")).otherwise(F.lit(PLAIN)))
    real = F.col("kind") != SIGN
    hot = F.max(F.col("kind").isin(SIGN, HOT)).over(part) | (F.count("*").over(part) > HOT_ROWS)
    seen = seen.withColumn("hot", hot)
    seen = seen.withColumn("low", F.min("seg").over(part)).withColumn("high", F.max("seg").over(part))
    seen = seen.withColumn("before", F.struct(F.lag("seg").over(along).alias("s"), F.lag("anchor").over(along).alias("a")))
    # a sign is a copy of a hot row, so it stands for a place of the corpus as well
    twin = (F.col("before.s") == F.col("seg")) & (F.col("before.a") == F.col("anchor"))
    state = F.when((F.col("kind") == REPEAT) | twin, "covered").when(F.col("hot") | (F.col("low") != F.col("high")), "open")
    seen = seen.withColumn("state", state)
    seen = seen.filter(real & F.col("state").isNotNull())
    seen = materialise(seen.select("state", "hot", "anchor", "seg", "ord", "tie", "start", "n"), "segments")

    todo = seen.filter("state = 'open'").groupBy("ord", "tie").agg(F.collect_list(F.struct("anchor", "seg", "hot", "start", "n")).alias("todo"))
    cut = todo.join(rows, ["ord", "tie"]).select("ord", "tie", "raw", F.inline("todo"))
    piece = F.expr(f"substring(raw, cast(start as int) + 1, cast(n as int) + {LENGTH - 1})")
    key = F.when(F.col("hot"), F.xxhash64("anchor", F.pmod("seg", F.lit(SALTS)))).otherwise(F.col("anchor"))
    cut = cut.select(key.alias("skey"), "hot", "ord", "tie", "start", piece.alias("bytes"))
    found = materialise(cut.repartition("skey").sortWithinPartitions("skey", "ord", "tie", "start").mapInArrow(_shards, COVER), "covers")

    met = Window.partitionBy("hi", "lo").orderBy("ord", "tie", "start")
    later = found.filter("hi is not null").withColumn("at", F.row_number().over(met)).filter("at > 1")
    cols = ("ord", "tie", "start", "n")
    return seen.filter("state = 'covered'").select(*cols).unionByName(found.filter("hi is null").select(*cols)).unionByName(later.select(*cols))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_removed, n_spans, spans, kept).

    spans: the removed runs of bytes (start, end); kept: the other bytes. doc_id must be an integer;
    it orders the documents, rows without one come last. Rows that share a doc_id (or lack one) are
    separate documents in the order of a hash of their texts; rows that repeat both are one
    document, whose result each of them gets. Null and empty texts, and those under LENGTH bytes,
    have nothing to remove; texts of any length are read whole. Empty input: empty result. Other
    columns of docs are ignored.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), raw.alias("raw"))
    shared = not base.groupBy("ord").count().filter("count > 1").isEmpty()
    base = base.withColumn("tie", F.xxhash64("raw") if shared else F.lit(0).cast("long"))
    rows = base.select("ord", "tie", "raw")
    runs = repeated_starts(rows.dropDuplicates(["ord", "tie"]) if shared else rows)
    runs = runs.groupBy("ord", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = base.join(runs, ["ord", "tie"], "left").select("doc_id", "raw", "starts", "counts")
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, starts, counts in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                spans = covered(raw, starts or [], counts or [])
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(raw[e:s] for e, s in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), [{"start": s, "end": e} for s, e in spans], kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
