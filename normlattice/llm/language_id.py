"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is read in small letters, all that is neither a letter nor beyond ASCII as a blank. Its
subwords are the runs of 2 to 4 bytes of words with a blank at both ends, each hashed to one of
BUCKETS embeddings. The mean of a text's embeddings goes through a linear layer and a softmax. Both
are trained in numpy by stochastic gradient descent on a sample of labelled documents. A part of
the sample isn't trained on: it gives the temperature of the softmax, and the least score from which
on ACCURACY of the predictions are right; predictions below it are marked as rejected.

The mean and the linear layer commute, so workers hold a row of logits for each bucket in place of
its embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import LOWER

#: Training documents in all and of one language, those with the least hash; languages, the most frequent ones. Each language has one document at least.
MAX_TRAINED, PER_LANGUAGE, MAX_LANGUAGES = 6000, 800, 256
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SIZES = (2, 3, 4)
DIM, EPOCHS, RATE = 16, 6, 0.5
#: Every so many documents of the sample calibrate.
CALIBRATING = 5
ACCURACY = 0.99
SEED = 5
UNKNOWN = "und"
#: Bytes of texts whose subwords are made at once; longer texts are taken in parts.
SLICE_BYTES = 1 << 20

_WORDS = bytes(b if b >= 128 or chr(b) in LOWER else 32 for b in range(256))


def normal(text: str) -> bytes:
    """The words of a text in small letters, with one blank before, between and after them; empty without a letter."""
    if not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()) + b" "


def subwords(x: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first byte) of the subwords that start before stop: none has a blank inside, nor blanks alone."""
    blank = x == 32
    codes = x.astype(np.uint32)
    found, places = [], []
    code, inner = codes, np.zeros(len(x), bool)
    for size in range(2, max(SIZES) + 1):
        m = len(x) - size + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | codes[size - 1 :]
        inner = inner[:m] | blank[size - 2 : size - 2 + m] if size > 2 else np.zeros(m, bool)
        if size in SIZES:
            out = inner | (blank[:m] & blank[1:]) if size == 2 else inner
            at = np.flatnonzero(~out[: min(m, stop)])
            h = (code[at] ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS))
            places.append(at)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(places)


def _slices(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the subwords of all texts, some SLICE_BYTES of them at a time."""
    x = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    for at in range(0, len(x), SLICE_BYTES):
        bucket, place = subwords(x[at : at + SLICE_BYTES + max(SIZES) - 1], SLICE_BYTES)
        yield np.searchsorted(ends, place + at, side="right"), bucket


def grouped(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """(first text, normal forms) of consecutive texts, of SLICE_BYTES in all or of one longer text."""
    held: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        raw = normal(t)
        if held and size + len(raw) > SLICE_BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of the subwords) of a normal form; both empty without subwords."""
    n = np.zeros(BUCKETS, np.int64)
    for _, bucket in _slices([raw]):
        n += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), (n[at] / max(1, n.sum())).astype(np.float32)


# ---------------------------------------------------------------- training


@dataclass
class Model:
    """languages in order; logits of each bucket (BUCKETS x languages), already divided by the temperature."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, languages); a row without subwords has the bias alone."""
        out = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), np.int64)
        for first, raws in grouped(texts):
            for text, bucket in _slices(raws):
                for at in range(0, len(bucket), part := max(1, (1 << 22) // max(1, len(self.languages)))):
                    t = text[at : at + part]
                    new = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else t
                    if len(t):
                        np.add.at(out, first + t[new], np.add.reduceat(self.logits[bucket[at : at + part]], new, axis=0))
                        n += np.bincount(first + t, minlength=len(n))
        return softmax(out / np.maximum(n, 1)[:, None] + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, linear layer, bias) after EPOCHS of single steps; the rate falls to zero.

    A step on a text's mean embedding is scaled by the sum of its squared shares, so that long and
    short texts move as far.
    """
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear = rng.normal(0, DIM**-0.5, (DIM, languages)).astype(np.float32)
    bias = np.zeros(languages, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            at, w = rows[k]
            mean = w @ embed[at]
            g = softmax(mean @ linear + bias).astype(np.float32)
            g[labels[k]] -= 1
            back = linear @ g
            linear -= rate * 0.1 * np.outer(mean, g)
            bias -= rate * 0.1 * g
            embed[at] -= np.outer(rate * w / max(float(w @ w), 1e-6), back)
    return embed, linear, bias


def calibrate(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(temperature, threshold): the temperature of least loss, and the least score from which on ACCURACY are right.

    One more document than there are counts as half wrong, so that scores stay below 1 where all are right.
    """
    if not len(z):
        return 1.0, 0.0
    soft = np.full(z.shape, 0.5 / (len(z) + 1) / max(1, z.shape[1] - 1))
    soft[np.arange(len(z)), labels] = 1 - 0.5 / (len(z) + 1)
    loss = lambda t: -(soft * np.log(np.maximum(softmax(z / t), 1e-12))).sum(1).mean()
    t = float(min(np.geomspace(0.05, 20, 61), key=loss))
    p = softmax(z / t)
    score, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(z) + 1)
    enough = np.flatnonzero(share >= ACCURACY)
    return t, float(score[order[enough[-1]]]) if len(enough) else 1.0


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_trained: int, per_language: int) -> DataFrame:
    """(lang, text) of the training documents: of each language those with the least hash of id and text.

    Languages are counted first and thinned to some twice the number, so that few texts are sorted.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("h"))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    each = max(1, min(per_language, max_trained // max(1, langs.count())))
    often = F.broadcast(langs.select("lang", F.least(F.lit(1.0), (2 * each + 50) / F.col("count")).alias("share")))
    thin = rows.join(often, "lang").filter(F.pmod("h", F.lit(1_000_003)) <= F.col("share") * 1_000_003)
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return thin.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= each).select("lang", "text", "at")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_trained: int = MAX_TRAINED, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the text and lang of docs, and nothing else.

    At most max_trained documents, per_language of one language and MAX_LANGUAGES languages (the most
    frequent) are learnt from; the sample goes by a hash of id and text. Rows without text, letter or
    lang count for nothing; repeated rows count each. What reaches the driver are the subword shares
    of the sample, at most BUCKETS numbers a document. Without any such row the model has no language.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [counted(normal(x.as_py())) for x in part.column(1)]
                cols = [pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w in rows], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], ["lang", "at", "buckets", "shares"])

    found = sample(docs, id_col, text_col, lang_col, max_trained, per_language).mapInArrow(run, "lang string, at int, buckets array<int>, shares array<float>")
    got = found.toArrow()
    langs = got.column("lang").to_pylist()
    vectors = [(i.values.to_numpy(), w.values.to_numpy()) for i, w in zip(got.column("buckets"), got.column("shares"), strict=True)]
    # in the order of the sample, whatever the order of the tasks
    order = sorted((k for k in range(len(langs)) if len(vectors[k][0])), key=lambda k: (langs[k], got.column("at")[k].as_py()))
    names = sorted({langs[k] for k in order})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    labels = np.array([names.index(langs[k]) for k in order])
    rows = [vectors[k] for k in order]
    apart = np.zeros(len(rows), bool)
    for c in range(len(names)):
        apart[np.flatnonzero(labels == c)[CALIBRATING - 1 :: CALIBRATING]] = True
    embed, linear, bias = train([r for r, a in zip(rows, apart) if not a], labels[~apart], len(names))
    table = embed @ linear
    z = np.array([w @ table[i] for (i, w), a in zip(rows, apart) if a]).reshape(-1, len(names)) + bias
    t, threshold = calibrate(z.astype(np.float64), labels[apart])
    return Model(names, (table / t).astype(np.float32), (bias / t).astype(np.float64), threshold)


# ---------------------------------------------------------------- the operator


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, lang_pred, score, rejected).

    lang_pred is the likeliest language (of equal ones the first), score its calibrated probability;
    rejected where the score is below the model's threshold. Null texts and those without a letter
    are UNKNOWN, with score 0, and rejected, as are all where the model has no language. Whole texts of any length are read, in parts.
    Repeated rows stay. Empty input: empty result. Other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [x.as_py() or "" for x in part.column(1)]
                known = np.array([bool(own.languages) and any(map(str.isalpha, t)) for t in texts], bool)
                p = own.probabilities(texts) if known.any() else np.zeros((len(texts), 1))
                best = p.argmax(1)
                score = np.where(known, p[np.arange(len(texts)), best], 0.0)
                names = [own.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                cols = [pa.array(names, pa.string()), pa.array(score), pa.array((score < own.threshold) | ~known)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(id_: Column) -> Column:
    """A quarter of the documents, from which nothing is learnt."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))
