"""Pairs of two corpora: all of them, or those whose similarity reaches a threshold.

Corpora are (id, text) or (id, vector) DataFrames. Every row is an item of its own: rows that share
an id, or repeat, give a pair each. With a positive threshold lexical pairs must share a term, and
not one of those that are too frequent and too light to reach it: rows meet on their signatures, and
what survives is verified with whole vectors. Dense vectors are dealt to cells round pivots and
multiplied in blocks, without the pairs of blocks whose angles rule the threshold out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..session import MAX_BROADCAST, materialise, ship, small

#: Rows in a block of a grid.
BLOCK_ROWS = 1000
#: Two or more letters, digits and underscores.
WORD = re.compile(r"\w{2,}")
#: Postings of the smaller side that are broadcast.
MAX_POSTINGS = 1_000_000
#: Of no effect since postings aren't joined with their weights; callers may still set it.
HOT_TERMS = 10_000
#: Bytes of text whose terms are counted together, and bytes of all texts for each bucket of terms.
CHUNK_CHARS, BUCKET_CHARS = 1 << 22, 1 << 22
#: Postings of a term that one task joins.
TERM_ROWS = 10_000


def _dealt(df: DataFrame, blocks: int, others: int, mine: str, peer: str) -> DataFrame:
    """A written table in so many blocks by turns, each row repeated for each block of the other side."""
    df = df.withColumn(mine, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    return df.withColumn(peer, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b: each two blocks meet in a task. Rows are dealt as written, so a repeated task deals alike."""
    a, b = (materialise(x, "side") for x in (a, b))
    m, n = (-(-x.count() // BLOCK_ROWS) or 1 for x in (a, b))
    return _dealt(a, m, n, "_i", "_j").join(_dealt(b, n, m, "_j", "_i"), ["_i", "_j"]).drop("_i", "_j")


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair with both texts: (src_id, tgt_id, src_text, tgt_text)."""
    return _grid(a.toDF("src_id", "src_text"), b.toDF("tgt_id", "tgt_text")).select("src_id", "tgt_id", "src_text", "tgt_text")


# ---------------------------------------------------------------- TF-IDF


def _numbered(corpus: DataFrame) -> DataFrame:
    return corpus.toDF("id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("string").alias("id"), "text")


def _spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes in fewer partitions than there are (a small file is one)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _chunked(corpus: DataFrame) -> DataFrame:
    """(chunk, rows, ids, texts): a corpus (id, text) or (row, id, text), some CHUNK_CHARS bytes of text in one row, as a written table."""
    ship(corpus.sparkSession)
    rows = _spread(corpus if "row" in corpus.columns else _numbered(corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, no, held, size = TaskContext.get().partitionId() << 33, 0, [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), pa.concat_arrays(whole.column(c).chunks))
            return pa.RecordBatch.from_arrays([pa.array([first + no]), *map(one, range(3))], ["chunk", "rows", "ids", "texts"])

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                done = int(ends[at - 1]) if at else 0
                n = min(int(np.searchsorted(ends, done + CHUNK_CHARS - size)) + 1, b.num_rows)
                held.append(b.slice(at, n - at))
                size += int(ends[n - 1]) - done
                at = n
                if size >= CHUNK_CHARS:
                    yield flush()
                    held, size, no = [], 0, no + 1
        if held:
            yield flush()

    return materialise(rows.mapInArrow(run, "chunk long, rows array<long>, ids array<string>, texts array<string>"), "chunks")


def _counted(text: str | None, stop: frozenset[str]) -> Counter:
    """The words and bigrams of a text."""
    words = [w for w in WORD.findall((text or "").lower()) if w not in stop]
    own = Counter(words)
    own.update(map(" ".join, zip(words, words[1:])))
    return own


def _by_bucket(terms: Iterable[str], buckets: int) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(buckets)]
    for t in terms:
        out[zlib.crc32(t.encode()) % buckets].append(t)
    for x in out:
        x.sort()
    return out


def _pack(x: bytes) -> bytes:
    return zlib.compress(x, 1)


def _frequencies(sides: Sequence[DataFrame], stop_words: Sequence[str]) -> tuple[int, DataFrame]:
    """The number of buckets, and (chunk, bucket, found): for each term of a bucket in a chunk of texts, by order, twice the rows of both sides that have it, and one more if both sides have it.

    A task tells each bucket the terms of a chunk and how many of its rows have them, once, packed; a
    bucket adds up and answers with the numbers alone, as the chunk has the same terms in the same order.
    So no posting is shuffled, and a frequent term is one word for each chunk.
    """
    stop = frozenset(stop_words)
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)))
    total = sum(x.agg(F.sum(size)).first()[0] or 0 for x in sides)
    buckets = max(8, -(-total // BUCKET_CHARS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                seen: Counter = Counter()
                for x in b.column(2)[k]:
                    seen.update(_counted(x.as_py(), stop).keys())
                own = _by_bucket(seen, buckets)
                full = [i for i in range(buckets) if own[i]]
                terms = [_pack("\n".join(own[i]).encode()) for i in full]
                counts = [_pack(np.array([seen[t] for t in own[i]], np.int32).tobytes()) for i in full]
                cols = [pa.array(full, pa.int32()), pa.array([b.column(1)[k].as_py()] * len(full), pa.int64()), pa.array([b.column(0)[k].as_py()] * len(full), pa.int32()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "side", "terms", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        seen: tuple[dict, dict] = ({}, {})
        told = lambda i: zlib.decompress(asked.column("terms")[i].as_py()).decode().split("\n")
        for i in range(asked.num_rows):
            n = seen[asked.column("side")[i].as_py()]
            for t, c in zip(told(i), np.frombuffer(zlib.decompress(asked.column("counts")[i].as_py()), np.int32).tolist(), strict=True):
                n[t] = n.get(t, 0) + c
        a, b = seen
        found = [_pack(np.array([2 * (a.get(t, 0) + b.get(t, 0)) + (t in a and t in b) for t in told(i)], np.int64).tobytes()) for i in range(asked.num_rows)]
        return pa.table({"side": asked.column("side"), "chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "found": pa.array(found, pa.binary())})

    texts = sides[0].select(F.lit(0).alias("side"), "chunk", "texts").unionByName(sides[1].select(F.lit(1).alias("side"), "chunk", "texts"))
    asked = texts.mapInArrow(ask, "bucket int, chunk long, side int, terms binary, counts binary")
    return buckets, materialise(asked.groupBy("bucket").applyInArrow(answer, "side int, chunk long, bucket int, found binary"), "frequencies")


def _weighed(chunks: DataFrame, found: DataFrame, rows: int, buckets: int, stop_words: Sequence[str], made, schema: str) -> DataFrame:
    """What `made` makes of the rows of each chunk that have a term: (row, id, terms, n, df, shared, w, norm), terms in order, w not yet divided by the norm.

    w is 1 + ln(n) times the idf ln((1 + rows) / (1 + df)) + 1.
    """
    stop = frozenset(stop_words)

    def vectors(texts: pa.Table, found: pa.Table) -> Iterator[tuple]:
        for k in range(texts.num_rows):
            own = [_counted(x.as_py(), stop) for x in texts.column("texts")[k]]
            dealt = _by_bucket(set().union(*own), buckets)
            place: dict[str, int] = {}
            told = []
            for bucket, x in zip(found.column("bucket").to_pylist(), found.column("found"), strict=True):
                told.append(np.frombuffer(zlib.decompress(x.as_py()), np.int64))
                place.update(zip(dealt[bucket], range(len(place), len(place) + len(dealt[bucket])), strict=True))
            told = np.concatenate(told) if told else np.zeros(0, np.int64)
            df, shared = told >> 1, (told & 1).astype(bool)
            idf = np.log((1 + rows) / (1 + df)) + 1
            for row, name, n in zip(texts.column("rows")[k].as_py(), texts.column("ids")[k].as_py(), own, strict=True):
                if n:
                    terms = sorted(n)
                    at, count = np.array([place[t] for t in terms]), np.array([n[t] for t in terms])
                    w = (1 + np.log(count)) * idf[at]
                    yield row, name, terms, count, df[at], shared[at], w, float(np.sqrt(w @ w))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        return made(vectors(texts, found))

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


_VECTORS = "row long, id string, terms array<string>, n array<int>, df array<long>, shared array<boolean>, norm double"


def _as_arrays(shared_only: bool):
    def made(vectors: Iterator[tuple]) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for row, name, terms, n, df, shared, _, norm in vectors:
            keep = np.flatnonzero(shared) if shared_only else np.arange(len(terms))
            for col, x in zip(out, (row, name, [terms[i] for i in keep], n[keep], df[keep], shared[keep], norm), strict=True):
                col.append(x)
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["row", "id", "terms", "n", "df", "shared", "norm"])

    return made


def _counted_sides(a: DataFrame, b: DataFrame, stop_words: Sequence[str]) -> tuple[list[DataFrame], list[DataFrame], int, int]:
    """Chunks of both corpora, the answers to each, the number of rows and that of buckets."""
    rows = a.count() + b.count()
    chunks = [_chunked(x) for x in (a, b)]
    buckets, found = _frequencies(chunks, stop_words)
    return chunks, [found.filter(F.col("side") == i).drop("side") for i in (0, 1)], rows, buckets


def _vectors(a: DataFrame, b: DataFrame, stop_words: Sequence[str], shared_only: bool = False) -> tuple[list[DataFrame], int]:
    """Written tables _VECTORS of both sides, a row for each row with a term, and the number of rows."""
    chunks, found, rows, buckets = _counted_sides(a, b, stop_words)
    return [materialise(_weighed(c, f, rows, buckets, stop_words, _as_arrays(shared_only), _VECTORS), "weights", compression="zstd") for c, f in zip(chunks, found, strict=True)], rows


def _each_term(vectors: DataFrame, rows: int) -> DataFrame:
    """(row, id, norm, term, df, shared, w) of each term of written vectors."""
    each = vectors.select("row", "id", "norm", F.inline(F.arrays_zip("terms", "n", "df", "shared"))).withColumnRenamed("terms", "term")
    w = (1 + F.log(F.col("n").cast("double"))) * (F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1)
    return each.select("row", "id", "norm", "term", "df", "shared", w.alias("w"))


def _sides(a: DataFrame, b: DataFrame, stop_words: Sequence[str], shared_only: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """(row, id, term, df, shared, w) of both corpora, and (row, id, norm) of each row with a term.

    shared_only: terms that one side alone has count for the norms only.
    """
    vectors, rows = _vectors(a, b, stop_words, shared_only)
    return [_each_term(x, rows).drop("norm") for x in vectors], [x.select("row", "id", "norm") for x in vectors]


def tfidf_weights(a: DataFrame, b: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(side, id, term, w): a unit vector for each row of both corpora."""
    vectors, rows = _vectors(a, b, stop_words)
    out = [_each_term(x, rows).select(F.lit(side).alias("side"), "id", "term", (F.col("w") / F.col("norm")).alias("w")) for side, x in zip("ab", vectors, strict=True)]
    return out[0].unionByName(out[1])


def _met(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Rows of both sides with a common term: (term, df, src_.., tgt_..).

    Postings of a side of checked size are broadcast, so that the rows of a document stand together
    and are summed before a shuffle; of two large sides terms are dealt by salt.
    """
    named = lambda x, side: x.select("term", "df", *(F.col(c).alias(f"{side}_{c}") for c in on))
    a, b = named(a, "src"), named(b, "tgt")
    m, n = a.count(), b.count()
    if min(m, n) <= MAX_POSTINGS:
        few, many = (a, b) if m <= n else (b, a)
        return many.join(F.broadcast(few.drop("df")), "term")
    salts = F.ceil(F.col("df") / TERM_ROWS)
    dealt = b.withColumn("salt", F.pmod(F.xxhash64("tgt_row"), salts))
    spread = a.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("df")
    return dealt.join(spread, ["term", "salt"])


def _ids(norms: list[DataFrame]) -> list[DataFrame]:
    return [x.toDF(f"{side}_row", f"{side}_id", f"{side}_norm") for x, side in zip(norms, ("src", "tgt"), strict=True)]


def _dot(a: DataFrame, b: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(src_row, tgt_row, src_id, tgt_id, s): cosines of all rows with a common term. Norms join the pairs, not the postings."""
    (wa, wb), norms = _sides(a, b, stop_words)
    pairs = _met(wa.filter("shared"), wb.filter("shared"), "row", "w").groupBy("src_row", "tgt_row").agg(F.sum(F.col("src_w") * F.col("tgt_w")).alias("dot"))
    na, nb = _ids(norms)
    pairs = pairs.join(na, "src_row").join(nb, "tgt_row")
    return pairs.select("src_row", "tgt_row", "src_id", "tgt_id", (F.col("dot") / (F.col("src_norm") * F.col("tgt_norm"))).alias("s"))


def signatures(vectors: DataFrame, most: DataFrame, threshold: float) -> DataFrame:
    """(row, term, df, u, rest, kept, left) of vectors (row, term, df, u) of terms that both sides have.

    The terms of a row are added from the most frequent one on. rest is what these terms up to this
    one can add to a cosine: their norm, or their weights times the greatest ones of the other side
    (most: term, most), whichever is less. kept terms, the rarer ones, are the row's signature: rest
    reaches the threshold there. left is the greatest rest of the terms that aren't kept.

    Both sides have the same order of terms. So where two signatures have no term in common, all
    common terms of the rows are beyond the rarer of the two ends, where that row's rest is too small.
    """
    along = Window.partitionBy("row").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    u = F.col("u")
    rest = F.least(F.sqrt(F.sum(u * u).over(along)), F.sum(u * F.col("most")).over(along))
    kept = F.col("rest") >= threshold * (1 - 1e-9)
    rows = vectors.join(small(most), "term").withColumn("rest", rest).withColumn("kept", kept)
    left = F.coalesce(F.max(F.when(~F.col("kept"), F.col("rest"))).over(Window.partitionBy("row")), F.lit(0.0))
    return rows.withColumn("left", left).drop("most")


def survivors(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(src_row, tgt_row): pairs of rows whose signatures meet and, with what is left of both, can reach the threshold."""
    sa, sb = (materialise(x.filter("kept"), "signatures") for x in (a, b))
    met = _met(sa, sb, "row", "u", "left").groupBy("src_row", "tgt_row")
    seen = met.agg(F.sum(F.col("src_u") * F.col("tgt_u")).alias("dot"), F.max("src_left").alias("src_left"), F.max("tgt_left").alias("tgt_left"))
    return seen.filter(F.col("dot") + F.col("src_left") + F.col("tgt_left") >= threshold * (1 - 1e-9)).select("src_row", "tgt_row")


def _pruned(a: DataFrame, b: DataFrame, stop_words: Sequence[str], threshold: float) -> DataFrame:
    """(src_id, tgt_id, s) of the pairs whose cosine reaches a positive threshold.

    The vectors of a side of checked size go to the workers, and the other side's rows meet them where
    they are weighed, so of a row only its pairs are moved. Two large sides are joined by signatures.
    """
    chunks, found, rows, buckets = _counted_sides(a, b, stop_words)
    arrays = lambda i: materialise(_weighed(chunks[i], found[i], rows, buckets, stop_words, _as_arrays(True), _VECTORS), "weights")
    sizes = [x.agg(F.sum(F.size("rows"))).first()[0] or 0 for x in chunks]
    few = 0 if sizes[0] <= sizes[1] else 1
    small_side = arrays(few)
    if (small_side.agg(F.sum(F.size("terms"))).first()[0] or 0) > MAX_POSTINGS or MAX_POSTINGS <= 0:
        sides = [small_side, arrays(1 - few)]
        sides = sides if few == 0 else sides[::-1]
        weighted, norms = [_each_term(x, rows) for x in sides], [x.select("row", "id", "norm") for x in sides]
        return _signed(weighted, norms, threshold)
    peers = small_side.select("id", "norm", "terms", "n", "df").toArrow()
    shared = a.sparkSession.sparkContext.broadcast(_index(peers, rows))
    pairs = _weighed(chunks[1 - few], found[1 - few], rows, buckets, stop_words, _met_few(shared, threshold), "few string, many string, s double")
    names = ("src_id", "tgt_id") if few == 0 else ("tgt_id", "src_id")
    return materialise(pairs.toDF(*names, "s"), "pairs").select("src_id", "tgt_id", "s")


def _index(peers: pa.Table, rows: int) -> tuple:
    """The unit vectors of a small side: ids, places of terms, the greatest weight of each, and postings by row and by term."""
    sizes = np.array([len(x) for x in peers.column("terms")], np.int64)
    flat = lambda c: [x for xs in peers.column(c).to_pylist() for x in xs]
    place: dict[str, int] = {}
    k = np.array([place.setdefault(t, len(place)) for t in flat("terms")], np.int64)
    w = (1 + np.log(np.array(flat("n"), np.float64))) * (np.log((1 + rows) / (1 + np.array(flat("df"), np.float64))) + 1)
    u = w / np.repeat(peers.column("norm").to_numpy(), sizes)
    most = np.zeros(len(place))
    np.maximum.at(most, k, u)
    order = np.argsort(k, kind="stable")
    begin = np.searchsorted(k[order], np.arange(len(place) + 1))
    return peers.column("id").to_pylist(), place, most, (np.append(0, np.cumsum(sizes)), k, u), (begin, np.repeat(np.arange(len(sizes)), sizes)[order], u[order])


def _stretches(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from begin[i] to begin[i + 1] of each i, one after another, and their numbers."""
    n = begin[which + 1] - begin[which]
    return np.arange(n.sum()) + np.repeat(begin[which] - np.cumsum(n) + n, n), n


def _met_few(shared, threshold: float):
    """(few, many, s) of rows with the small side's vectors: signatures as in signatures(), of the one side.

    What the terms that aren't kept can add to a cosine is under the threshold, so a pair that reaches
    it has a kept term in common; of these pairs the whole vectors are multiplied.
    """
    least = threshold * (1 - 1e-9)

    def made(vectors: Iterator[tuple]) -> pa.Table:
        ids, place, most, (row_at, row_k, row_u), (term_at, term_row, term_u) = shared.value
        few, many, s = [], [], []
        whole = np.zeros(len(place))
        for _, name, terms, _, df, both, w, norm in vectors:
            at = [i for i in np.flatnonzero(both).tolist() if terms[i] in place]
            if not at:
                continue
            k, u = np.array([place[terms[i]] for i in at]), w[at] / norm
            order = np.argsort(-df[at], kind="stable")
            k, u = k[order], u[order]
            rest = np.minimum(np.sqrt(np.cumsum(u * u)), np.cumsum(u * most[k]))
            cut = int(np.searchsorted(rest, least))
            if cut == len(k):
                continue
            posting, n = _stretches(term_at, k[cut:])
            rows, own = np.unique(term_row[posting], return_inverse=True)
            dots = np.bincount(own, np.repeat(u[cut:], n) * term_u[posting])
            rows = rows[dots + (rest[cut - 1] if cut else 0.0) >= least]
            if not len(rows):
                continue
            whole[k] = u
            posting, n = _stretches(row_at, rows)
            dots = np.add.reduceat(row_u[posting] * whole[row_k[posting]], np.cumsum(n) - n)
            whole[k] = 0
            for i in np.flatnonzero(dots >= threshold).tolist():
                few.append(ids[rows[i]])
                many.append(name)
                s.append(float(dots[i]))
        return pa.table([pa.array(few, pa.string()), pa.array(many, pa.string()), pa.array(s, pa.float64())], names=["few", "many", "s"])

    return made


def _signed(weighted: list[DataFrame], norms: list[DataFrame], threshold: float) -> DataFrame:
    """(src_id, tgt_id, s) of two large sides: rows meet on their signatures."""
    unit = [materialise(w.filter("shared").select("row", "term", "df", (F.col("w") / F.col("norm")).alias("u")), "vectors") for w in weighted]
    most = [x.groupBy("term").agg(F.max("u").alias("most")) for x in unit]
    signed = [signatures(x, m, threshold) for x, m in zip(unit, reversed(most), strict=True)]
    pairs = materialise(survivors(*signed, threshold), "survivors")
    # whole vectors of the rows that are left
    src, tgt = (x.join(small(pairs.select(F.col(f"{side}_row").alias("row")).distinct()), "row", "left_semi").select(F.col("row").alias(f"{side}_row"), "term", F.col("u").alias(f"{side}_u")) for x, side in zip(unit, ("src", "tgt"), strict=True))
    whole = pairs.join(small(src, MAX_POSTINGS), "src_row").join(tgt, ["tgt_row", "term"])
    whole = whole.groupBy("src_row", "tgt_row").agg(F.sum(F.col("src_u") * F.col("tgt_u")).alias("s")).filter(F.col("s") >= threshold)
    na, nb = (x.drop(f"{side}_norm") for x, side in zip(_ids(norms), ("src", "tgt"), strict=True))
    return whole.join(na, "src_row").join(nb, "tgt_row").select("src_id", "tgt_id", "s")


def tfidf_pairs(a: DataFrame, b: DataFrame, stop_words: Sequence[str], threshold: float = S.PAIR_THRESHOLDS["tfidf"]) -> DataFrame:
    """(src_id, tgt_id, score, predicted_rel) of pairs whose cosine reaches the threshold, before rounding.

    Null texts have no term and no pair. Rows that share an id are compared each for itself.
    """
    if threshold <= 0:
        raise ValueError("pairs without a common term need tfidf_grid")
    return _labelled(_pruned(a, b, stop_words, threshold), S.LEXICAL_CUTS)


def tfidf_grid(a: DataFrame, b: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(src_id, tgt_id, score) of every pair of rows, zero where no term is common."""
    a, b = (materialise(_numbered(x), "corpus") for x in (a, b))
    side = lambda x, name: x.select(F.col("row").alias(f"{name}_row"), F.col("id").alias(f"{name}_id"))
    dots = _dot(a, b, stop_words).select("src_row", "tgt_row", "s")
    full = _grid(side(a, "src"), side(b, "tgt")).join(dots, ["src_row", "tgt_row"], "left")
    return full.select("src_id", "tgt_id", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("score"))


def _labelled(pairs: DataFrame, cuts: Sequence[tuple[float, str]], *more: str) -> DataFrame:
    return pairs.select("src_id", "tgt_id", F.round("s", 4).alias("score"), *more, X.label_of(F.col("s"), cuts).alias("predicted_rel"))


# ---------------------------------------------------------------- keyword sets


#: Words of one bitmap, which is a long; sets that one task compares with as many, and rows of one set in a task.
BITS, SET_ROWS = 63, 10_000
#: To spare where bounds of sizes are rounded.
ROUNDING = 1e-9


def _chunks(order: Sequence) -> list[str]:
    """Arrays in SQL of each BITS members of an order; words are small letters, others are numbers."""
    return [f"array({', '.join(map(repr, order[j : j + BITS]))})" for j in range(0, len(order), BITS)]


def bitmaps(words: str, order: Sequence[str]) -> list[Column]:
    """A set of words, given in SQL, as longs: bit i of column j is word BITS * j + i of the order."""
    bit = "(bits, w) -> bits | if(array_contains({0}, w), shiftleft(1L, cast(array_position({0}, w) - 1 AS int)), 0L)"
    return [F.expr(f"aggregate({words}, 0L, {bit.format(x)})") for x in _chunks(order)]


def members(bits: Sequence[str], order: Sequence) -> Column:
    """The members of a bitmap, whose longs are given in SQL, by their order."""
    return F.expr(f"concat({', '.join(f'filter({x}, (m, i) -> getbit({c}, i) = 1)' for x, c in zip(_chunks(order), bits, strict=True))})")


def _size(bits: Sequence[str]) -> Column:
    return F.expr(" + ".join(f"bit_count({c})" for c in bits))


def _first(bits: Sequence[str]) -> Column:
    """The place of the lowest bit that is set."""
    return F.expr(f"coalesce({', '.join(f'if(({c}) <> 0, bit_count((({c}) & -({c})) - 1) + {BITS * j}, null)' for j, c in enumerate(bits))})")


def _ranked_sets(kinds: Sequence[DataFrame], order: Sequence[str]) -> list[DataFrame]:
    """Written tables (w.., n_rows, r.., size) of the different sets of both sides; bits r are ordered from the rarest word on."""
    width = -(-len(order) // BITS)
    w = [f"w{j}" for j in range(width)]
    words = members(w, order)
    both = kinds[0].select(*w).unionByName(kinds[1].select(*w))
    found = {r.k: r.n for r in both.select(F.explode(words).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    rarest = sorted(order, key=lambda x: (found.get(x, 0), x))
    r = [c.alias(f"r{j}") for j, c in enumerate(bitmaps("words", rarest))]
    return [materialise(x.select("*", words.alias("words")).select(*w, "n_rows", *r, _size(w).alias("size")), "sets") for x in kinds]


def prefixes(a: DataFrame, b: DataFrame, width: int, n_words: int, threshold: float) -> list[DataFrame]:
    """Both sides' sets, once for each rare word k that a partner must have too: (src_r.., src_size, tgt_size, k) and (tgt_r.., tgt_size, k).

    A partner of a set of n words has threshold * n to n / threshold words. With one of m words it
    shares threshold / (1 + threshold) * (m + n) of them, so the rarest shared one is among its first
    ones: all but as many, and one more.
    """
    t = min(threshold, 1.0)
    named = lambda x, side: x.select(*(F.col(f"r{j}").alias(f"{side}_r{j}") for j in range(width)), F.col("size").alias(f"{side}_size"))
    a, b = named(a, "src"), named(b, "tgt")
    n, m = F.col("src_size"), F.col("tgt_size")
    up = lambda x: F.ceil(x - ROUNDING).cast("int")
    most = F.greatest(n, F.least(F.floor(n / t + ROUNDING), F.lit(n_words)).cast("int"))
    a = a.withColumn("tgt_size", F.explode(F.sequence(up(n * t), most)))

    def exploded(x: DataFrame, side: str, length: Column) -> DataFrame:
        places = members([f"{side}_r{j}" for j in range(width)], range(n_words))
        return x.withColumn("k", F.explode(F.slice(places, F.lit(1), F.greatest(length, F.lit(0)))))

    return [exploded(a, "src", n - up((m + n) * (t / (1 + t))) + 1), exploded(b, "tgt", m - up(m * t) + 1)]


def _set_pairs(a: DataFrame, b: DataFrame, width: int, n_words: int, threshold: float) -> DataFrame:
    """(src_r.., tgt_r.., s) of the sets that are alike: they meet where they share the rarest word and the sizes fit.

    Sets of one word and size are dealt to blocks of SET_ROWS; each two blocks meet in a task.
    """
    a, b = prefixes(a, b, width, n_words, threshold)
    key = ["k", "tgt_size"]
    parts = lambda x, name: x.groupBy(*key).agg(F.ceil(F.count("*") / SET_ROWS).alias(name))
    # at most a row for each word and size
    dealt = materialise(parts(a, "src_parts").join(parts(b, "tgt_parts"), key), "set-blocks")

    def blocks(x: DataFrame, mine: str, peer: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*(f"{mine}_r{j}" for j in range(width))), F.col(f"{mine}_parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{peer}_parts") - 1))
        return x.join(small(dealt), key).withColumn(f"{mine}_part", own).withColumn(f"{peer}_part", each).drop("src_parts", "tgt_parts")

    met = blocks(a, "src", "tgt").join(blocks(b, "tgt", "src"), [*key, "src_part", "tgt_part"])
    shared = [f"src_r{j} & tgt_r{j}" for j in range(width)]
    n = _size(shared)
    met = met.filter(_first(shared) == F.col("k")).withColumn("s", n / (F.col("src_size") + F.col("tgt_size") - n))
    return met.filter(F.col("s") >= threshold).select(*(f"{side}_r{j}" for side in ("src", "tgt") for j in range(width)), "s")


def _with_rows(pairs: DataFrame, rows: DataFrame, kinds: DataFrame, side: str, width: int) -> DataFrame:
    """Pairs of sets with the rows that have the set of one side; rows of a frequent set are dealt as written."""
    w = [f"{side}_w{j}" for j in range(width)]
    named = lambda x, *more: x.select(*(F.col(f"w{j}").alias(f"{side}_w{j}") for j in range(width)), *more)
    total = kinds.agg(F.sum("n_rows")).first()[0] or 0
    most = max(SET_ROWS, total // MAX_BROADCAST)
    # fewer than MAX_BROADCAST sets have so many rows
    hot = F.broadcast(named(kinds.filter(F.col("n_rows") > most), F.ceil(F.col("n_rows") / most).alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    own = named(rows, F.col("id").alias(f"{side}_id"), F.monotonically_increasing_id().alias("turn")).join(hot, w, "left")
    own = own.withColumn("part", F.pmod("turn", n)).drop("turn", "parts")
    each = pairs.join(hot, w, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("parts")
    return each.join(own, [*w, "part"]).drop("part")


def jaccard_pairs(a: DataFrame, b: DataFrame, vocabulary: Sequence[str], threshold: float = S.PAIR_THRESHOLDS["jaccard"]) -> DataFrame:
    """(src_id, tgt_id, score, shared_keywords, predicted_rel) of pairs whose keyword sets are alike.

    Sets are bitmaps. Only the different ones of each side are compared, of which there are far fewer
    than rows: those with fitting sizes that share one of their rarest keywords (prefixes tells which).
    Then the rows with these sets follow, so rows that share an id or repeat give a pair each. Rows
    without a keyword, null texts among them, give none, nor does an empty vocabulary. No similarity is
    above 1, so neither does such a threshold.
    """
    if threshold <= 0:
        raise ValueError("pairs without a common keyword are not joined")
    # other words are no keywords of a text
    order = sorted({x for x in vocabulary if re.fullmatch("[a-z]{3,}", x)}) or ["none"]
    width = -(-len(order) // BITS)
    w = [f"w{j}" for j in range(width)]

    def side(df: DataFrame) -> DataFrame:
        rows = df.toDF("id", "text").select("id", X.keywords(F.col("text"), order if vocabulary else []).alias("k")).filter(F.size("k") > 0)
        return materialise(rows.select("id", *(c.alias(name) for c, name in zip(bitmaps("k", order), w, strict=True))), "bitmaps")

    rows = [side(x) for x in (a, b)]
    kinds = _ranked_sets([x.groupBy(*w).agg(F.count("*").alias("n_rows")) for x in rows], order)
    pairs = _set_pairs(*kinds, width, len(order), threshold)
    for name, x in zip(("src", "tgt"), kinds, strict=True):
        renamed = x.select(*(F.col(f"r{j}").alias(f"{name}_r{j}") for j in range(width)), *(F.col(c).alias(f"{name}_{c}") for c in w))
        pairs = pairs.join(small(renamed), [f"{name}_r{j}" for j in range(width)])
    pairs = materialise(pairs.select("s", *(f"{name}_{c}" for name in ("src", "tgt") for c in w)), "set-pairs")
    for name, own, kind in zip(("src", "tgt"), rows, kinds, strict=True):
        pairs = _with_rows(pairs, own, kind, name, width)
    shared = members([f"src_{c} & tgt_{c}" for c in w], order)
    return _labelled(pairs.withColumn("shared_keywords", shared), S.LEXICAL_CUTS, "shared_keywords")


# ---------------------------------------------------------------- dense vectors


#: Rows of a block of vectors; pivots of the vectors of one length; rings of a cell, from 0 to a right angle twice.
VECTOR_ROWS, MAX_PIVOTS, RINGS = 4096, 64, 16
#: Lengths of vectors that get pivots: the most frequent ones. Others form one cell for each length.
MAX_LENGTHS = 16
#: Angles are compared with this much to spare.
SLACK = 1e-6


def _units(df: DataFrame) -> DataFrame:
    """(id, v, len) of the vectors that aren't null, normalised, as a written table."""
    unit = df.toDF("id", "v").filter("v is not null").select("id", X.l2_normalised(F.col("v")).alias("v"))
    return materialise(unit.withColumn("len", F.size("v")), "units")


def pivots_of(a: DataFrame, b: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors at most MAX_PIVOTS of them, those with the least hash; one for each VECTOR_ROWS rows."""
    both = a.select("len", "v").unionByName(b.select("len", "v"))
    sizes = both.groupBy("len").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "len").limit(MAX_LENGTHS)
    least = Window.partitionBy("len").orderBy(F.xxhash64("v"))
    few = both.join(F.broadcast(sizes), "len").withColumn("at", F.row_number().over(least)).filter(F.col("at") <= F.least(F.ceil(F.col("n") / VECTOR_ROWS), F.lit(MAX_PIVOTS)))
    out: dict[int, list] = {}
    for r in few.select("len", "v").collect():
        out.setdefault(r.len, []).append(r.v)
    return {k: np.unique(np.array(v, np.float64), axis=0) for k, v in out.items()}


def celled(units: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, len, cell, angle, ring): the nearest pivot of each vector, the angle to it and its ring, as a written table.

    Vectors of a length without pivots have cell -1, and angle 0, which says nothing.
    """
    shared = units.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            lengths = b.column(2).to_numpy()
            for k in np.unique(lengths):
                if k and k in shared.value:
                    at = np.flatnonzero(lengths == k)
                    near = np.stack(b.column(1).take(pa.array(at)).to_numpy(zero_copy_only=False)) @ shared.value[k].T
                    cell[at] = near.argmax(1)
                    angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    kind = units.schema["id"].dataType.simpleString()
    out = units.mapInArrow(run, f"id {kind}, v array<double>, len int, cell int, angle double")
    return materialise(out.withColumn("ring", F.floor(F.col("angle") * (RINGS / np.pi)).cast("int")), "cells")


def _rings(cells: DataFrame, side: str) -> DataFrame:
    """(len, cell, ring, low, high, parts) of each ring that has rows: at most so many for each length as there are pivots and rings."""
    out = cells.groupBy("len", "cell", "ring").agg(F.min("angle").alias(f"{side}_low"), F.max("angle").alias(f"{side}_high"), F.ceil(F.count("*") / VECTOR_ROWS).alias(f"{side}_parts"))
    return out.withColumnRenamed("cell", f"{side}_cell").withColumnRenamed("ring", f"{side}_ring")


def ring_pairs(a: DataFrame, b: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(len, a_cell, a_ring, a_low, a_high, a_parts, b_.., least, kept): all pairs of rings with the least angle that the triangle inequality leaves.

    A pair isn't kept where even the cosine of that angle is below the threshold. a and b are celled().
    """
    spark = a.sparkSession
    apart = [(k, i, j, float(np.arccos(np.clip(x, -1, 1)))) for k, v in pivots.items() for i, row in enumerate(v @ v.T) for j, x in enumerate(row)]
    between = spark.createDataFrame(apart, "len int, a_cell int, b_cell int, apart double")
    met = _rings(a, "a").join(_rings(b, "b"), "len").join(F.broadcast(between), ["len", "a_cell", "b_cell"], "left")
    c = F.col
    least = F.greatest(c("apart") - c("a_high") - c("b_high"), c("a_low") - c("apart") - c("b_high"), c("b_low") - c("apart") - c("a_high"), F.lit(0.0))
    # the zero vector is at a right angle to all, which a ring's angles say as well; without pivots nothing is known
    least = F.when(c("apart").isNull(), 0.0).otherwise(least)
    most = float(np.arccos(np.clip(threshold, -1, 1)))
    return met.withColumn("least", least).withColumn("kept", (c("least") <= most + SLACK) | F.lit(threshold <= 0))


def _packed(cells: DataFrame, side: str) -> DataFrame:
    """(len, cell, ring, n, offset, first, last): rings in a row, so many before each of its length, and the blocks of VECTOR_ROWS rows that each lies in."""
    before = Window.partitionBy("len").orderBy("cell", "ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = cells.groupBy("len", "cell", "ring").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    block = lambda x: F.floor(x / VECTOR_ROWS)
    return rings.select("len", F.col("cell").alias(f"{side}_cell"), F.col("ring").alias(f"{side}_ring"), "n", "offset", block(F.col("offset")).alias("first"), block(F.col("offset") + F.col("n") - 1).alias("last"))


def _runs(t: pa.Table) -> list[tuple[np.ndarray, int, float, float]]:
    """(rows, cell, low, high) of each ring in a block."""
    cell, ring, angle = (t.column(c).to_numpy() for c in ("cell", "ring", "angle"))
    order = np.lexsort((ring, cell))
    ends = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(ring[order]) != 0)) + 1
    return [(rows, int(cell[rows[0]]), float(angle[rows].min()), float(angle[rows].max())) for rows in np.split(order, ends)]


def _multiplied(threshold: float, shared):
    """The pairs of two blocks; of their rings those are multiplied that the triangle inequality leaves. shared: a broadcast of pivots."""
    most = float(np.arccos(np.clip(threshold, -1, 1)))

    def kept(x: tuple, others: list[tuple], apart: np.ndarray | None) -> list[bool]:
        _, i, a_low, a_high = x
        if apart is None or threshold <= 0:
            return [True] * len(others)
        return [j < 0 or i < 0 or max(apart[i, j] - a_high - b_high, a_low - apart[i, j] - b_high, b_low - apart[i, j] - a_high) <= most + SLACK for _, j, b_low, b_high in others]

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            u, v = (np.stack(x.column("v").to_numpy()) for x in (left, right))
            pivots = shared.value.get(u.shape[1])
            apart = None if pivots is None else np.arccos(np.clip(pivots @ pivots.T, -1, 1))
            theirs = _runs(right)
            v, place = v[order := np.concatenate([x[0] for x in theirs])], order
            sizes = [len(x[0]) for x in theirs]
            # rings of the left side that meet the same ones of the right side go together
            alike: dict[bytes, list[np.ndarray]] = {}
            for x in _runs(left):
                alike.setdefault(np.repeat(kept(x, theirs, apart), sizes).tobytes(), []).append(x[0])
            for meets, rows in alike.items():
                cols = np.flatnonzero(np.frombuffer(meets, bool))
                if not len(cols):
                    continue
                peers = v if len(cols) == len(v) else v[cols]
                own = np.concatenate(rows)
                for at in range(0, len(own), 1024):
                    part = u[own[at : at + 1024]] @ peers.T
                    p, q = np.nonzero(part >= threshold)
                    i.append(own[p + at])
                    j.append(place[cols[q]])
                    s.append(part[p, q])
        i, j, s = (np.concatenate(x) for x in (i, j, s))
        return pa.table({"src_id": left.column("id").take(pa.array(i)), "tgt_id": right.column("id").take(pa.array(j)), "s": s})

    return multiply


def cosine_pairs(a: DataFrame, b: DataFrame, threshold: float, cuts: Sequence[tuple[float, str]] = S.SEMANTIC_CUTS) -> DataFrame:
    """(src_id, tgt_id, score, predicted_rel) of pairs of (id, vector) rows whose cosine reaches the threshold.

    Vectors are normalised first; null ones are left out, empty ones have no pair, and vectors of
    unequal length none with each other. Rows that repeat give a pair each. Each side is dealt to
    cells round common pivots and to rings of like angles in a cell; pairs of rings whose angles rule
    the threshold out are skipped (ring_pairs tells which). Rings stand in a row and are cut to blocks
    of VECTOR_ROWS rows; two blocks with rings that aren't skipped meet in a task. So a vector is moved
    once for each such block of the other side, not for each ring. An empty side gives an empty result.
    """
    ship(a.sparkSession)
    a, b = (_units(x).filter("len > 0") for x in (a, b))
    kinds = [x.schema["id"].dataType.simpleString() for x in (a, b)]
    pivots = pivots_of(a, b)
    a, b = (celled(x, pivots) for x in (a, b))
    packed = {side: materialise(_packed(x, side), "packed") for side, x in (("a", a), ("b", b))}
    pairs = ring_pairs(a, b, pivots, threshold).filter("kept").select("len", *(f"{s}_{c}" for s in "ab" for c in ("cell", "ring")))
    for s, x in packed.items():
        blocks = F.sequence("first", "last").alias(f"{s}_blocks")
        pairs = pairs.join(small(x.select("len", f"{s}_cell", f"{s}_ring", blocks)), ["len", f"{s}_cell", f"{s}_ring"])
    pairs = pairs.select("len", F.explode("a_blocks").alias("a_block"), "b_blocks").select("len", "a_block", F.explode("b_blocks").alias("b_block"))
    pairs = materialise(pairs.distinct(), "blocks")
    key = ["len", "a_block", "b_block"]

    def dealt(side: DataFrame, mine: str, peer: str) -> DataFrame:
        rows = side.withColumn("turn", F.monotonically_increasing_id()).withColumnsRenamed({"cell": f"{mine}_cell", "ring": f"{mine}_ring"})
        rows = rows.join(small(packed[mine].drop("first", "last")), ["len", f"{mine}_cell", f"{mine}_ring"])
        own = F.floor((F.col("offset") + F.pmod("turn", F.col("n"))) / VECTOR_ROWS)
        rows = rows.select("id", "v", F.col(f"{mine}_cell").alias("cell"), F.col(f"{mine}_ring").alias("ring"), "angle", "len", own.alias(f"{mine}_block"))
        peers = pairs.groupBy("len", f"{mine}_block").agg(F.collect_set(f"{peer}_block").alias("peers"))
        met = rows.join(small(peers), ["len", f"{mine}_block"]).withColumn(f"{peer}_block", F.explode("peers"))
        return met.select("id", "v", "cell", "ring", "angle", *key)

    left, right = dealt(a, "a", "b").groupBy(*key), dealt(b, "b", "a").groupBy(*key)
    shared = a.sparkSession.sparkContext.broadcast(pivots)
    out = left.cogroup(right).applyInArrow(_multiplied(threshold, shared), f"src_id {kinds[0]}, tgt_id {kinds[1]}, s double")
    return _labelled(out, cuts)


def mean_pooled(tokens: DataFrame, key: str = "id", vector: str = "vector", mask: str = "mask") -> DataFrame:
    """(key, vector): the mean of the token vectors whose mask is above 0, for each key.

    Whole vectors are summed up by key in each task before the shuffle, so no row for a dimension is
    moved and a key with many tokens is no skew; what is merged in the end are a key's sums, one or
    two for each length of its vectors. Null vectors count for nothing, null values for nothing at
    their place; beyond the end of shorter vectors the longer ones count. A place without any value
    is null. Null keys are a key, repeated rows count each. A key without a value left to count, or
    with empty vectors only, has no row. Empty input: empty result.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = F.col(vector).cast("array<double>")
    rows = tokens.filter((F.col(mask) > 0) & (F.size(vector) > 0)).select(F.col(key).alias("key"), v.alias("v"))
    holes = F.exists("v", lambda x: x.isNull())
    # zeros and, behind them, ones in place of the nulls of a vector that has some
    full = F.concat(F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))), F.transform("v", lambda x: F.when(x.isNull(), 1.0).otherwise(0.0)))
    rows = rows.select("key", F.size("v").alias("size"), holes.alias("holes"), array_to_vector(F.when(holes, full).otherwise(F.col("v"))).alias("v"))
    own = rows.groupBy("key", "size", "holes").agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m"))
    own = own.select("key", F.struct("size", "holes", "n", vector_to_array("m").alias("m")).alias("s"))
    sums = own.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("s.size").alias("size"))

    def mean(d: Column) -> Column:
        here = F.filter("s", lambda x: x["size"] > d)
        at = lambda x: F.element_at(x.m, d + 1)
        n = F.aggregate(here, F.lit(0.0), lambda t, x: t + x.n * F.when(x.holes, 1 - F.element_at(x.m, x["size"] + d + 1)).otherwise(1.0))
        return F.when(n > 0.5, F.aggregate(here, F.lit(0.0), lambda t, x: t + x.n * at(x)) / n)

    each = F.transform(F.sequence(F.lit(0), F.col("size") - 1), mean)
    one = (F.size("s") == 1) & ~F.element_at("s", 1).holes
    return sums.select(F.col("key").alias(key), F.when(one, F.element_at("s", 1).m).otherwise(each).alias(vector))


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs by descending score, then ids; the first k if given."""
    out = pairs.orderBy(F.desc("score"), "src_id", "tgt_id")
    return out if k is None else out.limit(k)
