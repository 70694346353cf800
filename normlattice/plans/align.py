"""The whole job: clauses of two corpora, lexical and dense predictions, evaluation, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import evaluation, providers, similarity
from ..sources import sinks


def predictions(a: DataFrame, b: DataFrame, vocabulary: Sequence[str] = S.KEYWORDS, stop_words: Sequence[str] = (), embedders: dict[str, Callable] | None = None) -> DataFrame:
    """Predictions of all methods for two corpora of provisions, as schemas.PREDICTION."""
    a, b = (x.select(F.col("provision_id").alias("id"), "text") for x in (a, b))
    parts = [("tfidf", similarity.tfidf_pairs(a, b, stop_words)), ("jaccard", similarity.jaccard_pairs(a, b, vocabulary))]
    for name, load in (embedders or {}).items():
        va, vb = providers.embed(a, load), providers.embed(b, load)
        parts.append((name, similarity.cosine_pairs(va, vb, S.PAIR_THRESHOLDS[name])))
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("method"), "src_id", "tgt_id", "score", "predicted_rel")
        out = df if out is None else out.unionByName(df)
    return out


def evaluate(truth: DataFrame, preds: DataFrame, methods: DataFrame) -> dict[str, DataFrame]:
    pairs = evaluation.compared(truth, preds, methods)
    confusion = evaluation.confusion_matrix(pairs)
    out = {
        "detection": evaluation.detection_metrics(truth, preds, methods),
        "macro": evaluation.macro_metrics(confusion),
        "classes": evaluation.class_metrics(confusion),
        "errors": evaluation.error_analysis(pairs),
        "comparison": pairs,
    }
    return out | {"summary": sinks.summary(out["detection"], out["macro"], out["classes"])}
