"""Reading the engine's relations."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import text as X
from . import records

ORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, in whatever file system the path names?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_provisions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of provisions, with is_void, the mark of those that are void (null: no mark)."""
    return records.read_json_array(spark, path, T.StructType([*S.PROVISION, T.StructField("is_void", T.BooleanType())]))


def without_void(df: DataFrame) -> DataFrame:
    """Rows that aren't marked void, without the mark; df as it is where it has none."""
    return df.filter(~F.coalesce(F.col("is_void"), F.lit(False))).drop("is_void") if "is_void" in df.columns else df


def with_merged(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_merged", X.merged_label(F.col(column)))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return with_merged(records.read_csv(spark, path, S.TRUTH).drop("ord"), "relationship")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks; tested before anything uses them."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def read_predictions(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A method's CSV with any score column, as schemas.PREDICTION with ord, the order of files by name and of rows in them."""
    df = require(records.read_csv(spark, path), "src_id", "tgt_id", "predicted_rel")
    score = next((c for c in df.columns if c.endswith("_score")), None)
    cols = [F.lit(method).alias("method"), "src_id", "tgt_id", (F.col(score).cast("double") if score else F.lit(None).cast("double")).alias("score"), "predicted_rel"]
    return with_merged(df.select(*cols, "ord"), "predicted_rel")


def read_all_predictions(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """The predictions of the methods whose file is there, and the names of the others."""
    found = [m for m in paths if exists(spark, paths[m])]
    out = spark.createDataFrame([], T.StructType([*S.PREDICTION, T.StructField("ord", ORD), T.StructField("predicted_rel_merged", T.StringType())]))
    for m in found:
        out = out.unionByName(read_predictions(spark, paths[m], m))
    return out, [m for m in paths if m not in found]


def read_summary(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Metrics rows that sinks.write_metrics wrote. Given the schema, per_class is a map as it was."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: evaluate first, which writes it")
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def inline_truth(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Labelled pairs given in code: (src_id, tgt_id, relationship, justification, confidence)."""
    return spark.createDataFrame(rows, S.TRUTH)


def dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Sections given in code: (section_id, title) or (section_id, title, phase)."""
    return spark.createDataFrame([(*r, None)[:3] for r in rows], S.DIMENSION)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_pdfs(spark: SparkSession, path: str, command: tuple[str, ...] = ("pdftotext", "-", "-")) -> DataFrame:
    """(path, text) of PDF files, converted by a tool on every executor that reads and writes streams; its failure fails the task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def convert(frames: Iterator) -> Iterator:
        import subprocess

        for f in frames:
            texts = [subprocess.run(list(command), input=bytes(c), capture_output=True, check=True).stdout.decode("utf-8") for c in f.content]
            yield f[["path"]].assign(text=texts)

    return files.mapInPandas(convert, "path string, text string")


def load_standard(df: DataFrame) -> DataFrame:
    """(path, text) with cleaned texts."""
    return df.withColumn("text", X.clean_text(F.col("text")))


@dataclass(frozen=True)
class ModelConfig:
    """Settings of remote models, read on the driver."""

    mode: str = "sync"
    retry_seconds: float = 10
    max_retries: int = 3
    poll_seconds: float = 30
    max_wait_seconds: float = 86_400
    api_key: str | None = None

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ, prefix: str = "MODEL_", need_key: bool = False) -> ModelConfig:
        """From variables with a prefix; an error where the key is needed and missing."""
        get = lambda name, default: env.get(prefix + name, default)
        key = env.get(prefix + "API_KEY")
        if need_key and not key:
            raise ValueError(f"{prefix}API_KEY is not set")
        return ModelConfig(str(get("MODE", "sync")).strip().lower(), float(get("RETRY_SECONDS", 10)), int(get("MAX_RETRIES", 3)), float(get("POLL_SECONDS", 30)), float(get("MAX_WAIT_SECONDS", 86_400)), key)


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a local settings file; comments and quotes are taken off."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out
