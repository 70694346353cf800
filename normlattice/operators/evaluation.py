"""Predictions against labelled pairs.

truth: (src_id, tgt_id, relationship). predictions: (method, src_id, tgt_id, predicted_rel[, ord]).
All methods are evaluated together; methods: (method) rows, so that one without predictions counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..session import small

PAIR = ["src_id", "tgt_id"]


def _related(c: str):
    return F.col(c) != S.NO_RELATION


def detection_metrics(truth: DataFrame, predictions: DataFrame, methods: DataFrame) -> DataFrame:
    """For each method: counts of labelled pairs found or missed, precision, recall and F1 (4 places).

    Pairs are sets: one counts as predicted if any of its predictions relates it; predictions of
    pairs that are not labelled are left out.
    """
    pairs = truth.groupBy(*PAIR).agg(F.max(_related("relationship")).alias("pos"), F.max(~_related("relationship")).alias("neg"))
    found = predictions.filter(_related("predicted_rel")).select("method", *PAIR).distinct()
    hits = found.join(pairs, PAIR).groupBy("method").agg(F.count("*").alias("n"), F.count_if("pos").alias("tp"))
    total = pairs.agg(F.count_if("pos").alias("p"), F.count_if("neg").alias("q"))
    out = methods.select("method").join(hits, "method", "left").fillna(0, ["n", "tp"]).crossJoin(F.broadcast(total))
    p, r = X.safe_ratio(F.col("tp"), F.col("n")), X.safe_ratio(F.col("tp"), F.col("p"))
    return out.select(
        "method",
        F.col("p").alias("positive_pairs"),
        F.col("q").alias("negative_pairs"),
        F.col("n").alias("predicted_pairs"),
        F.col("tp").alias("true_positives"),
        (F.col("n") - F.col("tp")).alias("false_positives"),
        (F.col("p") - F.col("tp")).alias("false_negatives"),
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(X.f1_of(p, r), 4).alias("f1"),
    )


def compared(truth: DataFrame, predictions: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, src_id, tgt_id, true_rel, pred_rel, correct): labels merged; no prediction means no relation.

    Of several predictions of a pair the last counts: the largest ord, if there is one, and of
    equals, or without ord, the label that comes last in the alphabet. A labelled pair that repeats
    is compared each time. A pair or label that is null matches nothing.
    """
    order = ["ord", "predicted_rel"] if "ord" in predictions.columns else ["predicted_rel"]
    last = predictions.groupBy("method", *PAIR).agg(F.max(F.struct(*order)).alias("_last"))
    pred = last.select("method", *PAIR, X.merged_label(F.col("_last.predicted_rel")).alias("pred_rel"))
    grid = truth.select(*PAIR, X.merged_label(F.col("relationship")).alias("true_rel")).crossJoin(small(methods.select("method")))
    out = grid.join(pred, ["method", *PAIR], "left").withColumn("pred_rel", F.coalesce("pred_rel", F.lit(S.NO_RELATION)))
    return out.select("method", *PAIR, "true_rel", "pred_rel", (F.col("true_rel") == F.col("pred_rel")).alias("correct"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("method", "true_rel", "pred_rel").agg(F.count("*").alias("n"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """(method, label, support, precision, recall, f1) of each label that occurs in the truth."""
    hit = F.sum(F.when(F.col("true_rel") == F.col("pred_rel"), F.col("n")).otherwise(0))
    rows = confusion.groupBy("method", F.col("true_rel").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    cols = confusion.groupBy("method", F.col("pred_rel").alias("label")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, ["method", "label"], "left").fillna(0, ["predicted"])
    p, r = X.safe_ratio(F.col("tp"), F.col("predicted")), X.safe_ratio(F.col("tp"), F.col("support"))
    return out.select("method", "label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(X.f1_of(p, r), 4).alias("f1"))


def macro_metrics(confusion: DataFrame) -> DataFrame:
    """(method, accuracy, macro_precision, macro_recall, macro_f1): means of the rounded class values."""
    right = F.sum(F.when(F.col("true_rel") == F.col("pred_rel"), F.col("n")).otherwise(0))
    accuracy = confusion.groupBy("method").agg(F.round(right / F.sum("n"), 4).alias("accuracy"))
    mean = [F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return accuracy.join(class_metrics(confusion).groupBy("method").agg(*mean), "method")


def error_analysis(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(method, error_type, src_id, tgt_id, true_rel, pred_rel, note) of the pairs that are wrong.

    A relation predicted for an unrelated pair is a wrong label, as the first test that fits
    decides; strict tests for it before.
    """
    t, p = _related("true_rel"), _related("pred_rel")
    missed = (t & ~p, "FALSE_NEGATIVE", "labelled pair that the method missed")
    wrong = ((F.col("true_rel") != F.col("pred_rel")) & p, "WRONG_LABEL", "pair found with another label")
    false = (~t & p, "FALSE_POSITIVE_ON_NEGATIVE", "relation predicted for an unrelated pair")
    kind, note = F, F
    for test, name, text in [missed, false, wrong] if strict else [missed, wrong, false]:
        kind, note = kind.when(test, name), note.when(test, text)
    out = pairs.select("method", kind.alias("error_type"), *PAIR, "true_rel", "pred_rel", note.alias("note"))
    return out.filter("error_type is not null")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n), the most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def method_dimension(spark, order: Sequence[str] = S.METHOD_ORDER) -> DataFrame:
    return spark.createDataFrame(list(enumerate(order)), "method_order int, method string").select("method", "method_order")


def best_method(metrics: DataFrame, methods: DataFrame) -> DataFrame:
    """The row of the largest macro_f1; of equals the first in the order of methods."""
    ranked = metrics.join(small(methods), "method").orderBy(F.desc("macro_f1"), "method_order")
    return ranked.limit(1).drop("method_order")


def pair_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).union(b.select(*PAIR)).distinct()


def pair_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).intersect(b.select(*PAIR))


def pair_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).subtract(b.select(*PAIR))


def counted(df: DataFrame, name: str, **counts: str) -> tuple[DataFrame, Observation]:
    """df, and the counts of its rows that an action on it will have made on the way: no second pass.

    counts: a name and a condition in SQL for each; rows counts all of them.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.expr(c)).alias(k) for k, c in counts.items())), seen


def report_rows(detection: DataFrame, macro: DataFrame, methods: DataFrame) -> DataFrame:
    """The comparison table of a report, formatted, in the order of methods."""
    out = detection.join(macro, "method").join(small(methods), "method")
    cols = [X.percent(F.col(c)).alias(f"{c}_pct") for c in ("precision", "recall", "f1", "accuracy", "macro_f1")]
    return out.orderBy("method_order").select("method", *cols)
