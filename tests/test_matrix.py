"""Score matrices in tiles, against the matrix that fits the driver."""

import numpy as np
import pytest

from normlattice.sources import matrix, sinks


@pytest.mark.parametrize("tile", [7, 256])
def test_tiles_hold_the_matrix(spark, tmp_path, tile):
    rng = np.random.default_rng(0)
    rows = {(f"s{i}", int(j)): round(float(rng.random()), 4) for i in range(40) for j in rng.choice(60, 5, replace=False)}
    scores = spark.createDataFrame([(*k, v) for k, v in rows.items()], "src_id string, tgt_id int, score double").repartition(5)
    path = f"{tmp_path}/m"
    matrix.write_matrix(scores, path, tile)
    src, tgt, want = sinks.dense_matrix(scores)
    got_rows, got_cols, tiles = matrix.read_matrix(spark, path)
    assert [(r.id, r.at) for r in got_rows.orderBy("at").collect()] == list(zip(src, range(len(src))))
    assert [(r.id, r.at) for r in got_cols.orderBy("at").collect()] == list(zip(tgt, range(len(tgt))))
    m, n = want.shape
    assert (matrix.matrix_block(spark, path, (0, m), (0, n)) == want).all()
    assert (matrix.matrix_block(spark, path, (5, 23), (11, 12)) == want[5:23, 11:12]).all()
    beyond = matrix.matrix_block(spark, path, (m - 3, m + 4), (0, n + 2))
    assert (beyond[:3, :n] == want[m - 3 :]).all() and not beyond[3:].any() and not beyond[:, n:].any()
    assert matrix.matrix_block(spark, path, (4, 4), (0, 3)).shape == (0, 3)
    assert all(len(t["values"]) == t.n_rows * t.n_cols and t.n_rows <= tile for t in tiles.collect())


def test_repeats_nulls_and_no_rows(spark, tmp_path):
    kind = "src_id long, tgt_id string, score float"
    scores = spark.createDataFrame([(1, "a", 0.25), (1, "a", 0.5), (None, "b", 0.75), (2, None, None), (2, None, None)], kind)
    path = f"{tmp_path}/m"
    matrix.write_matrix(scores, path)
    rows, columns, _ = matrix.read_matrix(spark, path)
    assert [r.id for r in rows.orderBy("at").collect()] == [None, 1, 2] and [r.id for r in columns.orderBy("at").collect()] == [None, "a", "b"]
    assert matrix.matrix_block(spark, path, (0, 3), (0, 3)).tolist() == [[0, 0, 0.75], [0, 0.5, 0], [0, 0, 0]]
    matrix.write_matrix(scores.limit(0), path)
    assert [x.count() for x in matrix.read_matrix(spark, path)] == [0, 0, 0]
    assert not matrix.matrix_block(spark, path, (0, 2), (0, 2)).any()


def test_cells_are_packed_by_tile(spark):
    import pyarrow as pa

    r, c = np.repeat(np.arange(30), 40), np.tile(np.arange(40), 30)
    cells = pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(np.where(c == 3, np.nan, r + c / 100.0), from_pandas=True)], ["r", "c", "score"])
    parts = [x for b in matrix._tiled(16, 40)(iter([cells])) for x in b.to_pylist()]
    assert len(parts) == 2 * 3  # a row for each tile, not for each cell
    assert sum(len(x["at"]) // 4 for x in parts) == 30 * 39


def test_cells_of_several_batches_are_packed_together():
    import pyarrow as pa

    one = lambda r: pa.RecordBatch.from_arrays([pa.array([r] * 40), pa.array(range(40)), pa.array([r / 2.0] * 40)], ["r", "c", "score"])
    parts = [x for b in matrix._tiled(16, 40)(iter([one(r) for r in range(30)])) for x in b.to_pylist()]
    assert len(parts) == 2 * 3 and sum(len(x["at"]) // 4 for x in parts) == 30 * 40


def test_readers_decode_few_tiles_at_once(spark, tmp_path):
    import pyarrow.parquet as pq

    cells = spark.range(3600).selectExpr("id div 60 AS src_id", "id % 60 AS tgt_id", "id / 10000.0D AS score")
    matrix.write_matrix(cells, f"{tmp_path}/m", 2)
    files = [pq.ParquetFile(x) for x in (tmp_path / "m" / "tiles").glob("*.parquet")]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 900 and max(groups) <= matrix.GROUP_TILES
    assert (matrix.matrix_block(spark, f"{tmp_path}/m", (0, 60), (0, 60)) == np.arange(3600).reshape(60, 60) / 10000.0).all()
