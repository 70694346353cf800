"""Quality of documents by a vote of their nearest labelled neighbours in a latent-semantic space.

Features are hashed counts of words and of word shapes (runs of small letters, capitals, digits and
each other character), shares of repeated words and lines, and the size of the text. They are
weighted by an inverse document frequency and reduced by a truncated singular value decomposition,
both fitted to at most MAX_LABELLED labelled documents, whose vectors every worker holds
(MAX_LABELLED x RANK floats). Each document's vector is compared with all of them, a block at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 4000
RANK = 48
NEIGHBOURS = 15
POWER = 4
SHAPES, WORDS, STATS = 1024, 2048, 64
DIMS = SHAPES + WORDS + STATS
#: Weight of each family of features.
SHAPE_WEIGHT, WORD_WEIGHT, STAT_WEIGHT = 1.0, 0.3, 1.0
BLOCK = 256

#: Small letters and all bytes of other scripts become a, capitals A, digits 0.
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 32 if 9 <= b < 14 else b for b in range(256))


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, weight) of a text's features; not empty for any text."""
    index: dict[int, float] = {}
    shaped = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    if len(shaped):
        shaped = shaped[np.append(True, shaped[1:] != shaped[:-1])]
    shapes = Counter(shaped.tobytes().split())
    words = raw.lower().split()
    n = len(words)
    for s, c in shapes.items():
        k = zlib.crc32(s) % SHAPES
        index[k] = index.get(k, 0.0) + c
    out = {k: SHAPE_WEIGHT * (v / n) ** 0.5 for k, v in index.items()}
    counts = Counter(words)
    norm = sum(c * c for c in counts.values()) ** 0.5
    for w, c in counts.items():
        k = SHAPES + zlib.crc32(w) % WORDS
        out[k] = out.get(k, 0.0) + WORD_WEIGHT * c / norm
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # shares, each as one of a few dimensions that neighbours with a like share have in common
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    shares = (len(counts) / n if n else 1.0, repeats / n if n else 0.0, len(set(lines)) / len(lines) if lines else 1.0, sum(c for c in counts.values() if c > 2) / n if n else 0.0)
    at = SHAPES + WORDS
    for i, x in enumerate(shares):
        out[at + 8 * i + min(7, int(x * 8))] = STAT_WEIGHT
    out[at + 32 + min(31, n.bit_length())] = STAT_WEIGHT
    return np.array(list(out), np.int64), np.array(list(out.values()), np.float32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [features(x.as_py()) for x in b.column(1)]
        cols = [b.column(0), pa.array([i.astype(np.int32) for i, _ in out], pa.list_(pa.int32())), pa.array([w for _, w in out], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cols, ["label", "dims", "weights"])


@dataclass
class Model:
    """scale x basis turns features into vectors; vectors and labels are those of the labelled documents."""

    scale: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, raws: list[bytes]) -> np.ndarray:
        out = np.zeros((len(raws), self.basis.shape[1]), np.float32)
        for k, raw in enumerate(raws):
            i, w = features(raw)
            out[k] = (w * self.scale[i]) @ self.basis[i]
        return _unit(out)

    def score(self, raws: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(raws), 0.5)
        cosine = np.clip(self.embed(raws) @ self.vectors.T, 0, 1)
        k = min(NEIGHBOURS, len(self.labels))
        # of equal neighbours at the end of the list the first ones count, in the order of their ids
        last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k][:, None]
        closer, tied = cosine > last, cosine == last
        near = closer | (tied & (np.cumsum(tied, axis=1) <= k - closer.sum(axis=1, keepdims=True)))
        w = np.where(near, cosine.astype(np.float64) ** POWER + 1e-9, 0)
        return np.clip((w @ self.labels) / w.sum(1), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rank: int = RANK) -> Model:
    """Fits the model to at most max_labelled labelled documents, those with the least hash of their id.

    What reaches the driver is a sparse vector for each of them. Labels without an id or value count for nothing; of several labels of one id the largest counts.
    Without any label every score is 0.5.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    # of rows that share an id one counts, so that no more rows than labels reach the driver
    least = F.min(F.struct(F.xxhash64("raw").alias("h"), F.col("raw"))).alias("m")
    chosen = texts.join(F.broadcast(rows), "id").groupBy("id", "label").agg(least).select(F.struct("id", "label").alias("label"), "m.raw")
    kind = chosen.schema["label"].dataType.simpleString()
    found = chosen.mapInArrow(_rows, f"label {kind}, dims array<int>, weights array<float>").toPandas()
    found = found.iloc[sorted(range(len(found)), key=lambda k: str(found.label.iloc[k]["id"]))]
    label = np.array([r["label"] for r in found.label], np.float64)
    a = np.zeros((len(found), DIMS), np.float32)
    for k, (i, w) in enumerate(zip(found.dims, found.weights, strict=True)):
        a[k, i] = w
    scale = (np.log((1 + len(a)) / (1 + (a > 0).sum(0))) + 1).astype(np.float32)
    a *= scale
    if not len(a):
        return Model(scale, np.zeros((DIMS, rank), np.float32), np.zeros((0, rank), np.float32), label)
    # randomised truncated SVD
    q = np.linalg.qr(a @ np.random.default_rng(0).standard_normal((DIMS, rank + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(a @ (a.T @ q))[0]
    basis = np.linalg.svd(q.T @ a, full_matrices=False)[2][:rank].T.astype(np.float32)
    return Model(scale, basis, _unit(a @ basis), label)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, score, predicted).

    A null text counts as empty, and empty ones have a score too; texts of any length are read whole.
    Of neighbours at equal distance the first ones in the order of their ids vote. Repeated rows
    stay. Empty input: empty result. Other columns of docs are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                s = own.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
