"""JSON arrays and CSV files with line breaks in quotes, read by many tasks a file.

Spark's text source splits a file at a character: every closing brace of JSON, every line feed of CSV,
whether in a string or not. What a task reads is gathered to chunks and written. Whether a chunk starts
inside a string depends on the quotes before it, so each is measured under both states: the parity of
its quotes and, of JSON, by how much it changes the depth. Sums over the chunks of a file, which are a
row of a few numbers each, tell the state of each chunk; then records are cut in each, and those that
lie across chunks are put together. No task needs a whole file, and rows are numbered exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship, small

#: Characters of a chunk; a longer record has chunks of its own.
CHUNK = 1 << 20
KEY = ["file", "start", "no"]
_ESCAPED = re.compile(r"\\.", re.S)
_MARKS = re.compile(r'\\.|["{}\[\]]', re.S)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[tuple]:
    """The rows of batches, of which few are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in b.slice(at, rows).columns), strict=True)


def _gathered(end: str, measure):
    """Consecutive rows of a split to chunks: (file, start, no, text, flips, out, inside, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, no, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            text = end.join(held) + end
            row = (*where, no, text, *measure(text), text.lstrip("\ufeff \t\r\n")[:1])
            return pa.RecordBatch.from_pylist([dict(zip(("file", "start", "no", "text", "flips", "out", "inside", "first"), row, strict=True))], _CHUNK_TYPE)

        for file, start, piece in _few(batches):
            if held and (size >= CHUNK or (file, start) != where):
                yield flush()
                held, size, no = [], 0, no + 1
            if (file, start) != where:
                where, no = (file, start), 0
            held.append(piece)
            size += len(piece) + 1
        if held:
            yield flush()

    return run


_CHUNK = "file string, start long, no long, text string, flips long, out long, inside long, first string"
_CHUNK_TYPE = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in _CHUNK.split(", ")])


def json_measure(text: str) -> tuple[int, int, int]:
    """(quotes, change of depth outside of strings, the same if the text starts in a string)."""
    parts = _ESCAPED.sub("", text).split('"')
    depth = lambda ps: sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in ps)
    return len(parts) - 1, depth(parts[::2]), depth(parts[1::2])


def csv_measure(text: str) -> tuple[int, int, int]:
    return text.count('"'), 0, 0


def json_ends(text: str, quoted: bool, depth: int, base: int) -> list[int]:
    """Where objects end that are members of the array, or stand alone (base 0)."""
    out = []
    for m in _MARKS.finditer(text):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and len(c) == 1:
            depth += 1 if c in "{[" else -1
            if c == "}" and depth == base:
                out.append(m.end())
    return out


def csv_ends(text: str, quoted: bool, depth: int, base: int) -> list[int]:
    """Where line feeds stand that aren't quoted."""
    out, at = [], 0
    for line in text.split("\n")[:-1]:
        quoted ^= bool(line.count('"') & 1)
        at += len(line) + 1
        if not quoted:
            out.append(at)
    return out


def _cut(ends):
    """Chunks with their states to (file, start, no, n, head, whole, tail): the n records that end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a chunk at a time, as a batch may hold many and Python's text takes up to four bytes a character
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                text, at = r["text"], ends(r["text"], bool(r["quoted"]), r["depth"], r["base"])
                row = {k: r[k] for k in KEY} | {"n": len(at), "head": text[: at[0]] if at else None, "whole": [text[x:y] for x, y in zip(at, at[1:])], "tail": text[at[-1] if at else 0 :]}
                yield pa.RecordBatch.from_pylist([row], _CUT_TYPE)

    return run


_CUT = "file string, start long, no long, n long, head string, whole array<string>, tail string"
_CUT_TYPE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("head", pa.string()), ("whole", pa.list_(pa.string())), ("tail", pa.string())])


def _records(spark: SparkSession, path: str, end: str, measure, ends) -> DataFrame:
    """(file, row, record): the records of files, numbered from 0 in each."""
    ship(spark)
    pieces = spark.read.text(path, lineSep=end).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    chunks = materialise(pieces.mapInArrow(_gathered(end, measure), _CHUNK), "chunks")
    # states: rows of a few numbers, one for each chunk
    order = Window.partitionBy("file").orderBy("start", "no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = chunks.select(*KEY, "flips", "out", "inside", "first")
    state = state.withColumn("quoted", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    change = F.when(F.col("quoted") == 0, F.col("out")).otherwise(F.col("inside"))
    state = state.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    base = (F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0)) == "[").cast("long")
    state = state.select(*KEY, "quoted", "depth", base.alias("base"))
    met = chunks.select(*KEY, "text").join(small(materialise(state, "states")), KEY)
    cut = materialise(met.mapInArrow(_cut(ends), _CUT), "cut")
    # the records that end before a chunk, and the chunks before it in which any does
    counts = cut.select(*KEY, "n").withColumn("row", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("joint", F.coalesce(F.sum((F.col("n") > 0).cast("long")).over(before), F.lit(0))).drop("n")
    numbered = cut.join(small(materialise(counts, "counts")), KEY)
    whole = numbered.select("file", "row", F.posexplode("whole").alias("k", "record")).select("file", (F.col("row") + 1 + F.col("k")).alias("row"), "record")
    # a tail goes on in the next chunks up to the first head
    tail_joint = F.col("joint") + (F.col("n") > 0).cast("long")
    parts = F.array(
        F.struct(F.col("joint").alias("joint"), F.col("row").alias("row"), F.col("head").alias("text")),
        F.struct(tail_joint.alias("joint"), (F.col("row") + F.col("n")).alias("row"), F.col("tail").alias("text")),
    )
    across = numbered.select(*KEY, F.inline(parts)).filter("text is not null and text <> ''")
    across = across.groupBy("file", "joint").agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("start", "no", "text"))).alias("parts"))
    across = across.select("file", "row", F.array_join(F.transform("parts", lambda p: p.text), "").alias("record"))
    return whole.unionByName(across)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, record): the objects in JSON arrays, or one after another, as text.

    Members of an array that aren't objects are left out, and what follows the last object is.
    Empty files and arrays have no record.
    """
    out = _records(spark, path, "}", json_measure, json_ends)
    text = F.regexp_replace("record", r"^[^{]*", "")
    return out.select("file", "row", text.alias("record")).filter(F.endswith("record", F.lit("}")) & F.startswith("record", F.lit("{")))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, record): the rows of CSV files with quotes doubled in quotes, without their line end; blank lines count but are left out."""
    out = _records(spark, path, "\n", csv_measure, csv_ends)
    text = F.regexp_replace("record", r"\r?\n$", "")
    return out.select("file", "row", F.when(F.col("row") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("record")).filter(F.trim("record") != "")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects in JSON arrays as rows; fields that an object lacks are null, malformed objects are null throughout."""
    return json_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of the first file."""
    first = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value").filter("start = 0")
    least = first.agg(F.min("file")).first()[0]
    if least is None:
        return []
    import csv

    return next(csv.reader([first.filter(F.col("file") == least).first().value.lstrip("\ufeff")]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of CSV files with a header each, and ord: (file, row), the place of each row.

    A schema goes by position; without one the first file's header names columns of text. Fields may
    have line breaks, commas and doubled quotes in quotes. An empty field is null. Header lines must not
    have a line break. Files without rows give none.
    """
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header(spark, path)])
    rows = csv_records(spark, path).filter("row > 0")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", F.lit(kinds), {"quote": '"', "escape": '"'}) if schema.fields else F.struct(F.lit(None).alias("_"))
    out = rows.select(parsed.alias("r"), F.struct(F.element_at(F.split("file", "/"), -1).alias("file"), "row").alias("ord"))
    return out.select(*(F.col("r")[f.name].alias(f.name) for f in schema), "ord")


def numbered(rows: DataFrame) -> DataFrame:
    """rows of read_csv() with number, their place from 0 over all files in the order of names: exact, by sums over files."""
    files = rows.groupBy(F.col("ord.file").alias("_file")).agg(F.max("ord.row").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_file", F.col("ord.file")).join(small(files), "_file").withColumn("number", F.col("ord.row") - 1 + F.col("_before")).drop("_file", "_before")
