"""Clauses of documents that keep arriving: the extraction operators are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extraction


def arriving_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files as they appear under path."""
    rows = spark.readStream.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_provisions(docs: DataFrame, dimension: DataFrame, out: str, checkpoint: str, kind: str = "a") -> StreamingQuery:
    """Starts a query that appends the provisions of arriving documents as Parquet."""
    find = {"a": extraction.provisions_a, "b": extraction.provisions_b}[kind]
    return find(docs, "text", dimension).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
