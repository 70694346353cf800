"""Clauses from whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialise, small

#: The word that each clause begins with; files are split at it.
WORD = "Provision"

# fixed values: clause headers and ends of the two kinds of documents
CLAUSE_A = r"Provision\s+(5\.\d{1,2}-\d+[A-Z]?)\s+(.*?)(?=Provision\s+5\.\d|^\d+\s+|\z)"
CLAUSE_B = r"Provision\s+(5\.\d+\.\d+-\d+(?:\.\d+)?)\s+(.*?)(?=Provision\s+5\.\d|\z)"


def matches(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """A row (all columns of df, pos, match) for each match of a pattern, in order."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return df.select("*", F.posexplode(found).alias("pos", "match"))


def clauses(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(all columns but the text, pos, provision_id, body) of each clause; bodies are stripped."""
    pattern = X.DOTALL_LINES + pattern
    out = matches(df, text_col, pattern)
    parts = [F.regexp_extract("match", pattern, i) for i in (1, 2)]
    keep = [c for c in df.columns if c != text_col]
    return out.select(*keep, "pos", parts[0].alias("provision_id"), X.strip(parts[1]).alias("body"))


def titled(df: DataFrame, dimension: DataFrame, key: str = "section_id") -> DataFrame:
    """df with the title of its section, Unknown where the dimension has none."""
    dim = small(dimension.select(F.col(key), F.col("title")))
    return df.join(dim, key, "left").withColumn("title", F.coalesce("title", F.lit("Unknown")))


def provisions(found: DataFrame, standard: str, parts: int, dimension: DataFrame) -> DataFrame:
    """Clauses as provisions, in the shape of schemas.PROVISION."""
    out = found.withColumn("section_id", X.section_of(F.col("provision_id"), parts))
    out = titled(out, dimension).withColumn("modality", X.modality(F.col("body")))
    return out.select("provision_id", F.lit(standard).alias("standard"), "section_id", "title", F.col("body").alias("text"), "modality")


def provisions_a(df: DataFrame, text_col: str, dimension: DataFrame, standard: str = "EN 303 645") -> DataFrame:
    """Annexes cut off, clauses with explanations trimmed and void ones dropped."""
    cut = df.withColumn(text_col, X.cut_at_marker(X.clean_text(F.col(text_col))))
    found = clauses(cut, text_col, CLAUSE_A).withColumn("body", X.trim_explanations(F.col("body")))
    return provisions(found.filter(~X.is_void(F.col("body"))), standard, 2, dimension)


def provisions_b(df: DataFrame, text_col: str, dimension: DataFrame, standard: str = "EN 304 223") -> DataFrame:
    """Clauses up to the next header: page numbers and headings between them stay in the text."""
    found = clauses(df.withColumn(text_col, X.clean_text(F.col(text_col))), text_col, CLAUSE_B)
    return provisions(found, standard, 3, dimension)


# ---------------------------------------------------------------- documents of any size


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, piece): what stands between the words WORD of text files, cleaned, as a written table.

    Spark's text source splits files at the word, so a file is read by many tasks; at ascends within
    a split. No pattern that is cleaned away has the word in it.
    """
    rows = spark.read.text(path, lineSep=WORD)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), X.clean_lines(F.col("value")).alias("piece"))
    return materialise(rows, "pieces")


def _stripped(piece: Column, first: Column, last: Column) -> Column:
    """A piece with the white space at the ends of its document taken off."""
    head, tail = F.when(first, F.regexp_replace(piece, rf"\A{X._WHITE}+", "")).otherwise(piece), rf"{X._WHITE}+\z"
    return F.when(last, F.regexp_replace(head, tail, "")).otherwise(head)


def _islands(spark: SparkSession, path: str, marker: str | None, after: int) -> DataFrame:
    """(file, island, text): what stands from one head of a clause to the next, the word included.

    A piece that begins like a head begins an island; others, where prose has the word, go on with
    it. Which island a piece belongs to and where it begins in its document are sums over the pieces
    before it, of rows without their texts; so only a clause, not a document, must fit a task. Files
    are numbers meanwhile: their names are far longer than a piece, and shuffled names are packed so
    well that a partition of usual size would be many times as large in the memory of its task.
    """
    key, pieces = ["no", "start", "at"], _pieces(spark, path)
    files = materialise(pieces.select("file").distinct().withColumn("no", F.monotonically_increasing_id()), "files")
    order = Window.partitionBy("no").orderBy("start", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = pieces.join(small(files), "file").select(*key, F.char_length("piece").alias("n"), F.char_length(F.regexp_replace("piece", rf"\A{X._WHITE}+", "")).alias("bare"), F.col("piece").rlike(r"\A\s+5\.\d").alias("head"))
    slim = slim.withColumn("first", F.row_number().over(order) == 1).withColumn("last", F.lead("at").over(order).isNull())
    slim = slim.withColumn("head", F.col("head") & ~F.col("first"))
    own = F.when(F.col("first"), F.col("bare")).otherwise(F.col("n")) + len(WORD)
    slim = slim.withColumn("own", own).withColumn("offset", F.coalesce(F.sum("own").over(before), F.lit(0)))
    slim = slim.withColumn("island", F.sum(F.col("head").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    slim = materialise(slim.select(*key, "first", "last", "offset", "island"), "islands")
    # at is a piece's own
    rows = pieces.select("at", "piece").join(small(slim), "at").withColumn("piece", _stripped(F.col("piece"), F.col("first"), F.col("last")))
    if marker is not None:
        place = F.call_function("locate", F.lit(marker), F.col("piece"), F.greatest(F.lit(after + 1) - F.col("offset"), F.lit(1)).cast("int"))
        rows = materialise(rows.withColumn("cut", place), "rows")
        ends = rows.filter("cut > 0").groupBy(F.col("no").alias("_no")).agg(F.min(F.struct("start", "at")).alias("_end"))
        rows = rows.join(small(ends), F.col("no") == F.col("_no"), "left")
        here = F.struct("start", "at")
        rows = rows.filter(F.col("_end").isNull() | (here <= F.col("_end")))
        rows = rows.withColumn("piece", F.when(here == F.col("_end"), F.substring("piece", F.lit(1), F.col("cut") - 1)).otherwise(F.col("piece")))
    found = rows.filter("island > 0").groupBy("no", "island").agg(F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("p"))
    return found.join(small(files), "no").select("file", "island", F.concat(F.lit(WORD), F.array_join(F.transform("p", lambda x: x.piece), WORD)).alias("text"))


def clauses_of_files(spark: SparkSession, path: str, pattern: str, marker: str | None = None, after: int = X.MARKER_AFTER) -> DataFrame:
    """(file, pos, provision_id, body): the clauses of cleaned text files of any size, as clauses() finds them in whole texts.

    With a marker, what follows its first place at or after an offset is cut off. Files are UTF-8;
    empty ones and those without clauses give no row. pos orders the clauses of a file.
    """
    found = clauses(_islands(spark, path, marker, after), "text", pattern).filter("pos = 0")
    return found.select("file", F.col("island").alias("pos"), "provision_id", "body")


def provisions_a_of_files(spark: SparkSession, path: str, dimension: DataFrame, standard: str = "EN 303 645") -> DataFrame:
    """provisions_a() of text files of any size."""
    found = clauses_of_files(spark, path, CLAUSE_A, X.MARKER).withColumn("body", X.trim_explanations(F.col("body")))
    return provisions(found.filter(~X.is_void(F.col("body"))), standard, 2, dimension)


def provisions_b_of_files(spark: SparkSession, path: str, dimension: DataFrame, standard: str = "EN 304 223") -> DataFrame:
    """provisions_b() of text files of any size."""
    return provisions(clauses_of_files(spark, path, CLAUSE_B), standard, 3, dimension)
