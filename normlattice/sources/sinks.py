"""Writing results. Parquet between stages; JSON, CSV, matrices and reports for people."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ship

#: Bytes of a fragment that are held when fragments are put together.
COPIED = 1 << 20


def write_rows(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").options(**options).parquet(path)


def _json_fragments(df: DataFrame, first: str = "", last: str | None = None) -> DataFrame:
    """(value): the rows of df as JSON; in each task the first one follows `first`, others a comma, and `last` ends a task that has rows."""

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = first
        for b in batches:
            lines = []
            for x in b.column(0).to_pylist():
                lines.append(lead + x)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if lead == "," and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last])], ["value"])

    ship(df.sparkSession)
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(led, "value string")


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file, in the order of df's rows, in any file system that Spark writes.

    Each task writes a fragment, which Spark commits, so a lost executor costs its fragments alone. The
    last step orders them and copies them into one file, with brackets and commas between, through a
    buffer of fixed size in the driver's JVM: file systems don't agree on what joining files means. The
    file gets its name when it is whole; one of that name is replaced. No rows: an empty array. Nulls
    are written as null. For data that one process shouldn't copy there is write_json_arrays.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    target, work = at(path), at(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    try:
        _json_fragments(df).write.option("maxRecordsPerFile", 0).option("compression", "none").text(f"{work}/fragments")
        listed = [f.getPath() for f in fs.listStatus(at(work, "fragments")) if f.getLen() and f.getPath().getName().startswith("part-")]
        listed.sort(key=lambda p: int(p.getName().split("-")[1]))
        whole = at(work, "whole")
        out = fs.create(whole, True)
        try:
            out.write(bytearray(b"[\n"))
            for i, p in enumerate(listed):
                if i:
                    out.write(bytearray(b","))
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, COPIED, False)
                finally:
                    part.close()
            out.write(bytearray(b"]\n"))
        finally:
            out.close()
        fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"can't rename {whole} to {path}")
    finally:
        fs.delete(work, True)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A folder of files, each a JSON array, written by the tasks and committed by Spark; nothing passes the driver."""
    _json_fragments(df, "[", "]").write.mode("overwrite").text(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays of strings as text of a list, which CSV can hold."""
    return df.select(*(X.list_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV files with doubled quotes, in a folder for each value of `by` if given."""
    writer = csv_ready(df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path, header=True, quote='"', escape='"')


def dense_matrix(scores: DataFrame):
    """(src_ids, tgt_ids, matrix) of (src_id, tgt_id, score) rows that fit the driver; ids in order, no pair: 0."""
    import numpy as np

    pdf = scores.select("src_id", "tgt_id", "score").toPandas()
    src, tgt = (sorted(pdf[c].unique()) for c in ("src_id", "tgt_id"))
    out = np.zeros((len(src), len(tgt)))
    at = ({x: i for i, x in enumerate(ids)} for ids in (src, tgt))
    rows, cols = (pdf[c].map(m) for c, m in zip(("src_id", "tgt_id"), at, strict=True))
    out[rows, cols] = pdf.score
    return src, tgt, out


def summary(detection: DataFrame, macro: DataFrame, classes: DataFrame) -> DataFrame:
    """(method, detection, classification): nested metrics, a row for each method."""
    own = lambda df: F.struct(*(c for c in df.columns if c != "method"))
    per = classes.groupBy("method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("support", "precision", "recall", "f1").alias("m"))))).alias("per_class"))
    d = detection.select("method", own(detection).alias("detection"))
    m = macro.join(per, "method").withColumn("c", F.struct(*(c for c in macro.columns if c != "method"), "per_class"))
    return d.join(m.select("method", F.col("c").alias("classification")), "method")


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(rows: DataFrame, order: list[str], truth: DataFrame, today: datetime.date | None = None, titles: dict[str, str] | None = None) -> str:
    """A report of summary() rows: a table of methods, the best one, and each in detail. Truth is counted."""
    titles = titles or {}
    found = {r.method: r for r in rows.collect()}
    methods = [m for m in order if m in found]
    n = truth.agg(F.count("*").alias("n"), F.count_if(F.col("relationship") == "NO_RELATION").alias("no")).first()
    pct, dec = (lambda v: f"{v * 100:.1f}%"), (lambda v: f"{v:.3f}")
    out = ["# Alignment report", "", f"Date: {(today or datetime.date.today()).isoformat()}", f"Labelled pairs: {n.n} ({n.n - n.no} related, {n.no} not)", ""]
    out += ["| Method | Precision | Recall | F1 | Accuracy | Macro-F1 |", "|---|---:|---:|---:|---:|---:|"]
    for m in methods:
        d, c = found[m].detection, found[m].classification
        out.append(f"| {titles.get(m, m)} | {pct(d.precision)} | {pct(d.recall)} | {pct(d.f1)} | {pct(c.accuracy)} | {pct(c.macro_f1)} |")
    if methods:
        best = max(methods, key=lambda m: found[m].classification.macro_f1)
        d, c = found[best].detection, found[best].classification
        out += ["", f"Best by macro-F1: {titles.get(best, best)} with {pct(c.macro_f1)}; detection precision {pct(d.precision)}, recall {pct(d.recall)}, F1 {pct(d.f1)}."]
    for m in methods:
        d, c = found[m].detection, found[m].classification
        out += ["", f"## {titles.get(m, m)}", "", f"Detection: precision {dec(d.precision)}, recall {dec(d.recall)}, F1 {dec(d.f1)}; {d.true_positives} of {d.positive_pairs} related pairs found, {d.false_positives} unrelated ones taken for related, {d.false_negatives} missed, {d.predicted_pairs} predicted."]
        out += [f"Classification: accuracy {dec(c.accuracy)}, macro-F1 {dec(c.macro_f1)}.", "", "| Label | Support | Precision | Recall | F1 |", "|---|---:|---:|---:|---:|"]
        out += [f"| {k} | {v.support} | {dec(v.precision)} | {dec(v.recall)} | {dec(v.f1)} |" for k, v in sorted(c.per_class.items())]
    out += ["", "Only labelled pairs count. Both kinds of subsumption are one label in classification.", ""]
    return "\n".join(out)


def console(df: DataFrame, title: str, rows: int = 10, show=print) -> None:
    """The first rows of a result as lines for a terminal, under its title and columns."""
    show(f"{title}: {', '.join(df.columns)}")
    for r in df.take(rows):
        show("  " + ", ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r))


def write_text(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
