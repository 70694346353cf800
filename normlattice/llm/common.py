"""Helpers that the training-data operators share: scratch tables and graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import MAX_BROADCAST, materialise, scratch_dir, small  # noqa: F401

#: Bytes that separate words, as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch in the pipeline: its workers hold a batch and what they make of it.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """From now on a worker of this session gets at most BATCH_ROWS texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the id, the text as UTF-8 bytes (null: empty), and more, whatever else docs has."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"),
        *(F.col(c) for c in more),
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    own = {c.lower() for c in df.columns}
    while any(c.startswith(stem.lower()) for c in own):
        stem = "_" + stem
    return stem


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def join_unique(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a table of one row for each key and n, the rows that have it: no task gets those of a frequent key.

    A small table is broadcast. Else the keys with more than 1 / MAX_BROADCAST of all rows are,
    which are fewer than that, and the others are joined by a shuffle.
    """
    count, total = table.agg(F.count("*"), F.sum("n")).first()
    if count <= MAX_BROADCAST:
        return rows.join(F.broadcast(table.drop("n")), key)
    hot = F.col("n") > total / MAX_BROADCAST
    often = F.broadcast(table.filter(hot).drop("n"))
    plain = rows.join(often.select(key), key, "left_anti").join(table.filter(~hot).drop("n"), key)
    return rows.join(often, key).unionByName(plain)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges (a, b) the smallest node of its component.

    Alternating large-star and small-star contraction until nothing changes: each round is two
    aggregations and joins, O(log^2 n) rounds. Each round's edges are a written table. Minima are
    combined before the shuffle; edges of hubs meet their minimum by a broadcast of checked size.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialise(e.distinct(), "edges")
    before, now = None, _state(e)
    while now != before and now[0]:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        least = materialise(least, "least")
        large = join_unique(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node's smaller neighbours and itself go to the smallest of them
        large = materialise(large.filter("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = materialise(least, "least")
        small_star = join_unique(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small_star.union(least.select("a", "m").toDF("a", "b")).filter("a <> b").distinct(), "edges")
        before, now = now, _state(e)
    star = e.toDF("node", "root")
    return star.union(star.select(F.col("root"), F.col("root")).distinct().toDF("node", "root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
