"""Score matrices of any size as a folder: tiles, and the ids of rows and columns by place.

Tasks write the tiles and Spark commits them, so neither the driver nor a task holds the matrix. A
tile without a score isn't written and is all zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, ship, small

#: Rows and columns of a tile.
TILE = 256
#: Tiles of a row group: a reader that decodes many rows at once has no more of them in memory.
GROUP_TILES = 16
#: Cells that a task packs at once.
CELLS = 1 << 21
#: Ids of a side that are broadcast with their places.
MAX_IDS = 2_000_000
#: Bits of monotonically_increasing_id that count within a partition.
_TURN = 33


def placed(ids: DataFrame) -> DataFrame:
    """(id, at) of the different values of a one-column table, in order from 0 on, null first.

    A range partitioning sorts them; their places follow from sums over its partitions.
    """
    rows = ids.toDF("id").distinct().orderBy(F.col("id").asc_nulls_first()).withColumn("m", F.monotonically_increasing_id())
    rows = materialise(rows, "places")
    part = F.shiftright("m", _TURN)
    # one row for each partition
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.withColumn("part", part).join(F.broadcast(first), "part").select("id", (F.col("first") + F.col("m").bitwiseAND(F.lit((1 << _TURN) - 1))).alias("at"))


def _tiled(tile: int, n_cols: int):
    """Cells (r, c, score) to parts of tiles: (i, j, at, values) of the scores that aren't null."""

    width = -(-n_cols // tile)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        r, c = (np.concatenate([b.column(x).to_numpy() for b in held]) for x in range(2))
        s, some = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held]), np.concatenate([b.column(2).is_valid().to_numpy(zero_copy_only=False) for b in held])
        t = r // tile * width + c // tile
        order = np.argsort(t, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(t[order]) != 0))
        at = (r % tile * tile + c % tile).astype(np.uint32)
        parts = [x[some[x]] for x in np.split(order, starts[1:])]
        own = t[order[starts]]
        cols = [pa.array(own // width), pa.array(own % width), pa.array([at[x].tobytes() for x in parts], pa.binary()), pa.array([s[x].tobytes() for x in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["i", "j", "at", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CELLS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _filled(tile: int, n_rows: int, n_cols: int):
    def fill(parts: pa.Table) -> pa.Table:
        i, j = parts.column("i")[0].as_py(), parts.column("j")[0].as_py()
        rows, cols = min(tile, n_rows - i * tile), min(tile, n_cols - j * tile)
        at, s = (np.concatenate([np.frombuffer(x.as_py(), t) for x in parts.column(c)]) for c, t in (("at", np.uint32), ("values", np.float64)))
        whole, seen = np.full(tile * tile, -np.inf), np.zeros(tile * tile, bool)
        np.maximum.at(whole, at, s)
        seen[at] = True
        out = np.where(seen, whole, 0.0).reshape(tile, tile)[:rows, :cols]
        one = {"tile_row": [i], "tile_col": [j], "n_rows": [rows], "n_cols": [cols], "values": [out.ravel()]}
        return pa.table({k: pa.array(v, pa.list_(pa.float64()) if k == "values" else pa.int64()) for k, v in one.items()})

    return fill


def write_matrix(scores: DataFrame, path: str, tile: int = TILE) -> None:
    """Writes (src_id, tgt_id, score) rows: path/rows and path/columns (id, at), path/tiles.

    A tile is (tile_row, tile_col, n_rows, n_cols, values), row by row; those at the lower and right
    edge are smaller. Ids stand in order, a null id first. Of a pair that repeats the greatest score
    counts; without a pair, or with a null score, a cell is 0. No rows: no ids and no tiles.
    """
    spark = scores.sparkSession
    ship(spark)
    cells = materialise(scores.select("src_id", "tgt_id", F.col("score").cast("double").alias("score")), "cells")
    sides = []
    for name, c in (("rows", "src_id"), ("columns", "tgt_id")):
        placed(cells.select(c)).write.mode("overwrite").parquet(f"{path}/{name}")
        sides.append(spark.read.parquet(f"{path}/{name}"))
    n_rows, n_cols = (x.count() for x in sides)
    for x, c, at in zip(sides, ("src_id", "tgt_id"), ("r", "c"), strict=True):
        own = x.toDF("own", at)
        cells = cells.join(small(own, MAX_IDS), F.col(c).eqNullSafe(F.col("own"))).drop("own", c)
    # what is shuffled are the scores that a task has of a tile, packed
    parts = cells.select("r", "c", "score").mapInArrow(_tiled(tile, n_cols), "i long, j long, at binary, values binary")
    out = parts.groupBy("i", "j").applyInArrow(_filled(tile, n_rows, n_cols), "tile_row long, tile_col long, n_rows long, n_cols long, values array<double>")
    # Spark decodes 4,096 rows at once, and of tiles these would be some GB; it stops at the end of a row group
    out.withColumn("size", F.lit(tile)).write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_TILES).parquet(f"{path}/tiles")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, columns, tiles) of a written matrix."""
    rows, columns, tiles = (spark.read.parquet(f"{path}/{x}") for x in ("rows", "columns", "tiles"))
    return rows, columns, tiles


def matrix_block(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    """The cells of places rows[0] to rows[1] and cols[0] to cols[1], ends exclusive, on the driver; only the tiles that have some are read.

    Places beyond the matrix are zeros.
    """
    out = np.zeros((max(rows[1] - rows[0], 0), max(cols[1] - cols[0], 0)))
    if not out.size:
        return out
    tiles = read_matrix(spark, path)[2]
    meets = lambda at, ends: (F.col(at) * F.col("size") < ends[1]) & ((F.col(at) + 1) * F.col("size") > ends[0])
    for t in tiles.filter(meets("tile_row", rows) & meets("tile_col", cols)).toLocalIterator():
        own = np.array(t["values"]).reshape(t.n_rows, t.n_cols)
        r, c = t.tile_row * t.size - rows[0], t.tile_col * t.size - cols[0]
        part = own[max(-r, 0) : out.shape[0] - r, max(-c, 0) : out.shape[1] - c]
        out[max(r, 0) : max(r, 0) + part.shape[0], max(c, 0) : max(c, 0) + part.shape[1]] = part
    return out
