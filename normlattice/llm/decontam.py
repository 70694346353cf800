"""Benchmark decontamination: rare n-gram seeds join documents to test items, local alignment scores them.

1. The word n-grams of the test items are a table. A blocked Bloom filter of them, of at most
   MAX_BLOCKS words of 64 bits, goes to the workers, which send on the n-grams of documents that pass.
2. These are counted over all documents. Seeds are the items' n-grams in at most RARE_DOCS documents
   or RARE_SHARE of them, and of every WINDOW consecutive n-grams of an item the rarest one: any run of
   SEED_WORDS + WINDOW - 1 unedited words has a seed, however often an item has been copied.
3. Documents and items meet on seeds; seeds of many documents are broadcast, which are few.
4. A text with a seed, once however many documents have it, and the items that it met stand
   together, and are aligned around the seeds (Smith-Waterman on words). The score is the
   alignment's share of the item's score with itself; 1 is a full copy.

Neither the driver nor a worker holds the items: memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, fresh, materialise, small
from .url_filter import without

SEED_WORDS = 3
WINDOW = 3
RARE_DOCS, RARE_SHARE = 50, 1e-3
#: The least score of a copy; items of under LONG_ITEM words, which chance meets more often, need SHORT_MORE on top.
MIN_SCORE, LONG_ITEM, SHORT_MORE = 0.40, 24, 0.05
MATCH, MISMATCH, GAP = 2, -1, -2
WORD = re.compile(r"\w+")
#: Blocks of the filter; n-grams for each; bits of an n-gram in its block.
MAX_BLOCKS, PER_BLOCK, BITS = 1 << 20, 4, 4
#: Characters of items that are broadcast to the pairs; more are joined by a shuffle.
BROADCAST_CHARS = 8_000_000
#: Words that a worker remembers the hashes of.
MEMO = 100_000
_M = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[str, int] = {}


def hashed(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    import xxhash

    words = WORD.findall(text.lower())
    try:
        return np.array([_memo[w] for w in words], np.uint64)
    except KeyError:
        if len(_memo) > MEMO:
            _memo.clear()
        own = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words) if w not in _memo}
        if len(own) <= MEMO:
            _memo.update(own)
        return np.array([own[w] if w in own else _memo[w] for w in words], np.uint64)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words, as signed longs."""
    n = len(words) - width + 1
    if n <= 0 or width < 1:
        return np.zeros(0, np.int64)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ words[i : i + n]) * _M
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word numbers: (score, first, end) in text.

    Word 0 of text matches nothing. Of equal scores the first end wins.
    """
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0
    step = GAP * np.arange(n + 1)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item.tolist():
        diag = score[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(np.maximum(diag, up), 0)
        frm = np.arange(n + 1)
        frm[1:] = np.where(diag >= up, origin[:-1], origin[1:])
        frm[now == 0] = np.flatnonzero(now == 0)
        # gaps in the item: the best start of a run of skipped words to the left
        run = now - step
        top = np.maximum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        origin, score = frm[at], top + step
        if (m := int(score.max())) > best[0]:
            e = int(score.argmax())
            best = (m, int(origin[e]), e)
    return best


def least_score(n_words: int, min_score: float = MIN_SCORE) -> float:
    return min_score + (SHORT_MORE if n_words < LONG_ITEM else 0)


def aligned(words: np.ndarray, item: np.ndarray, seeds: np.ndarray, text_grams: np.ndarray, min_score: float) -> tuple[float, int, int] | None:
    """(score, first word, end word) of the best alignment of an item around its seeds, if it reaches min_score.

    words, item: hashes of words; seeds: places of the item's seeds; text_grams: the text's n-grams of the item's width.
    """
    m, width = len(item), min(SEED_WORDS, len(item))
    min_score = least_score(m, min_score)
    kinds, own = np.unique(item, return_inverse=True)
    tally = np.bincount(own)
    i = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    text = np.where(kinds[i] == words, i + 1, 0)
    code = grams(item, width)[seeds]
    order = np.argsort(code, kind="stable")
    code, place = code[order], seeds[order]
    lo, hi = np.searchsorted(code, text_grams, "left"), np.searchsorted(code, text_grams, "right")
    n = hi - lo
    if not n.any():
        return None
    entry = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    start = np.unique(np.repeat(np.arange(len(n)), n) - place[entry])
    slack = m // 2 + 2
    spans: list[list[int]] = []
    for s in start.tolist():
        a, b = max(0, s - slack), min(len(text), s + m + slack)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    best = (0, 0, 0)
    for a, b in spans:
        # no alignment has more matches than words in common
        if np.minimum(np.bincount(text[a:b], minlength=len(kinds) + 1)[1:], tally).sum() < min_score * m:
            continue
        score, x, y = align(own + 1, text[a:b])
        if score > best[0]:
            best = (score, a + x, a + y)
    share = best[0] / (MATCH * m)
    return (share, best[1], best[2]) if share >= min_score else None


# ---------------------------------------------------------------- seeds


def _item_grams(items: DataFrame) -> DataFrame:
    """(key, pos, gram, last) of items (key, text): items of fewer words than a seed are one n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, own = [], []
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = hashed(x.as_py())
                keys.append(k)
                own.append(grams(words, min(SEED_WORDS, len(words))))
            n = np.array([len(g) for g in own], np.int64)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.array([min(SEED_WORDS, len(hashed(x.as_py()))) for x in b.column(1)], np.int32)
            cols = [np.repeat(np.array(keys, np.int64), n), pos.astype(np.int32), np.concatenate([np.zeros(0, np.int64), *own]), np.repeat(width, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "pos", "gram", "width"])

    return items.select("key", "text").mapInArrow(run, "key long, pos int, gram long, width int")


def _filter_of(own: DataFrame) -> np.ndarray:
    """A blocked Bloom filter of the column gram: one word of 64 bits a block."""
    n = own.count()
    blocks = min(MAX_BLOCKS, 1 << max(4, (n // PER_BLOCK).bit_length()))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned("gram", 20 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    found = own.groupBy(F.col("gram").bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(F.bit_or(mask).alias("bits")).toPandas()
    out = np.zeros(blocks, np.uint64)
    out[found.block.to_numpy(np.int64)] = found.bits.to_numpy(np.int64).view(np.uint64)
    return out


def _passes(gram: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = gram.view(np.uint64)
    word = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
    ok = np.ones(len(h), bool)
    for i in range(BITS):
        ok &= (word >> ((h >> np.uint64(20 + 6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _document_grams(texts: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(text_hash, gram): the different n-grams of each row of texts (text_hash, text) that the filter passes."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                key, found = b.column(0).to_numpy(), []
                for x in b.column(1):
                    words = hashed(x.as_py())
                    g = np.concatenate([grams(words, w) for w in widths])
                    found.append(np.unique(g[_passes(g, own)]))
                n = [len(g) for g in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["text_hash", "gram"])

    return texts.mapInArrow(run, "text_hash long, gram long")


def _seeds(own: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(key, places, grams, width): each item's seeds."""
    rare = max(RARE_DOCS, RARE_SHARE * n_docs)
    rows = own.join(counts, "gram", "left").select("key", "width", F.struct("pos", "gram", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    rows = rows.groupBy("key", "width").agg(F.array_sort(F.collect_list("g")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, codes = [], []
            for g in b.column(2):
                flat = g.values
                df, code = flat.field("n").to_numpy(), flat.field("gram").to_numpy()
                keep = df <= rare
                span = np.lib.stride_tricks.sliding_window_view(df, min(WINDOW, len(df)))
                keep[np.arange(len(span)) + span.argmin(axis=1)] = True
                places.append(np.flatnonzero(keep).astype(np.int32))
                codes.append(code[keep])
            cols = [b.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int64())), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "places", "grams", "width"])

    return rows.select("key", "width", "g").mapInArrow(run, "key long, places array<int>, grams array<long>, width int")


def _met(found: DataFrame, seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """(text_hash, key) of texts and items with a common seed.

    Few seeds are broadcast. Of more, those in over 1 / MAX_BROADCAST of all rows are, which are
    fewer than that, and the others are joined by a shuffle, so no task gets the rows of a frequent one.
    """
    rows = seeds.select("key", F.explode("grams").alias("gram")).distinct()
    if rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        pairs = found.join(F.broadcast(rows), "gram")
    else:
        often = F.broadcast(counts.filter(F.col("n") > found.count() / MAX_BROADCAST).select("gram"))
        plain = found.join(often, "gram", "left_anti").join(rows.join(often, "gram", "left_anti"), "gram")
        hot = rows.join(often, "gram")
        pairs = plain.unionByName(found.join(often, "gram", "left_semi").join(small(hot), "gram"))
    return pairs.select("text_hash", "key").distinct()


def _align_all(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    """Rows (text_hash, key, text, places): a text's own row, without key, stands before its items."""
    names = ["text_hash", "key", "score", "start", "end", "n_words"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    at, text, words, places = None, "", np.zeros(0, np.uint64), None
    codes: dict[int, np.ndarray] = {}
    for b in batches:
        out = []
        for h, key, body, seeds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if key is None:
                if h != at:
                    at, text, places, codes = h, body.as_py(), None, {}
                    words = hashed(text)
                continue
            if h != at:
                raise RuntimeError("an item stands without its text")
            item = hashed(body.as_py())
            width = min(SEED_WORDS, len(item))
            if width not in codes:
                codes[width] = grams(words, width)
            got = aligned(words, item, seeds.values.to_numpy().astype(np.int64), codes[width], min_score)
            if got:
                places = _places(text) if places is None else places
                out.append((h, key, got[0], places[got[1]][0], places[got[2] - 1][1], len(item)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _copies(texts: DataFrame, items: DataFrame, min_score: float) -> DataFrame:
    """(text_hash, key, score, start, end, n_words) of texts (text_hash, text), which may repeat, and items (key, text)."""
    own = materialise(_item_grams(items), "item-grams")
    widths = sorted(r.width for r in own.select("width").distinct().collect()) or [SEED_WORDS]
    found = materialise(_document_grams(texts, _filter_of(own), widths), "document-grams")
    counts = materialise(found.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    seeds = materialise(_seeds(own, counts, texts.count()), "seeds")
    pairs = materialise(_met(found, seeds, counts), "met")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [i for i, h in enumerate(b.column(0).to_pylist()) if not (h in seen or seen.add(h))]
            yield b.take(pa.array(new, pa.int64()))

    bodies = texts.join(small(pairs.select("text_hash").distinct()), "text_hash", "left_semi").select("text_hash", "text")
    bodies = bodies.mapInArrow(once, "text_hash long, text string")
    bodies = bodies.select("text_hash", F.lit(None).cast("long").alias("key"), "text", F.lit(None).cast("array<int>").alias("places"))
    asked = items.join(seeds.select("key", "places"), "key")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    asked = pairs.join(F.broadcast(asked) if chars <= BROADCAST_CHARS else asked, "key").select("text_hash", "key", "text", "places")
    rows = bodies.unionByName(asked).repartition("text_hash").sortWithinPartitions("text_hash", F.col("key").asc_nulls_first())
    return materialise(rows.mapInArrow(lambda b: _align_all(b, min_score), "text_hash long, key long, score double, start long, end long, n_words long"), "copies")


def _sides(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    rows = rows.withColumn("key", F.xxhash64("item_id", "text")).dropDuplicates(["key"])
    return texts.select(F.xxhash64("text").alias("text_hash"), "text"), materialise(rows, "items")


def find_copies(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row for each document and test item that it has a copy of.

    (doc_id, item_id, score, start, end, n_words): the best alignment's share of the item's score
    with itself, its code points in the text (end exclusive) and the item's words. Null and wordless
    texts and items match nothing. Repeated rows of docs give repeated rows, repeated items none. Of
    equal alignments the first counts. Empty input: empty result. Other columns are ignored.
    """
    texts, rows = _sides(docs, items, text_col, item_id, item_text)
    found = _copies(texts, rows.select("key", "text"), min_score)
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).filter(F.col(text_col).isNotNull())
    out = named.join(small(found), "text_hash").join(small(rows.select("key", "item_id")), "key")
    return out.select("doc_id", "item_id", "score", "start", "end", "n_words")


def _places(text: str) -> list[tuple[int, int]]:
    """Code points in text of each word of text.lower(), which can be longer than text."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(back[a], back[b - 1] + 1) for a, b in spans]


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that have a copy of a test item; no shuffle of the texts that stay.

    Null and wordless texts stay, repeated rows stay or go together. Empty items: docs as they are.
    """
    texts, rows = _sides(docs, items, text_col, item_id, item_text)
    pre = fresh(docs, "_copy_")
    gone = _copies(texts, rows.select("key", "text"), min_score).select(F.col("text_hash").alias(f"{pre}gone")).distinct()
    # a null text has a hash of its own, which no text is looked up by
    own = docs.withColumn(f"{pre}h", F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col).cast("string"))))
    return without(own, materialise(gone, "contaminated"), F.col(f"{pre}h") == F.col(f"{pre}gone"), f"{pre}h", f"{pre}gone").select(*docs.columns)
