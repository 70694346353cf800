"""One JSON array in one file, from fragments that tasks write."""

import json

import pytest

from normlattice.sources import sinks

ROWS = [(i, None if i % 7 == 0 else f'line\n"{i}", [\\]', ["é", None] * (i % 3)) for i in range(95)]


@pytest.mark.parametrize("parts", [1, 6])
def test_one_array_in_the_order_of_rows(spark, tmp_path, parts):
    df = spark.createDataFrame(ROWS, "i long, a string, n array<string>").repartition(parts).orderBy("i")
    sinks.write_json_array(df, f"file://{tmp_path}/rows.json")
    got = json.loads((tmp_path / "rows.json").read_text(encoding="utf-8"))
    assert [(r["i"], r["a"], r["n"]) for r in got] == ROWS
    # what was there is replaced, and nothing else stays
    sinks.write_json_array(df.filter("i in (3, 90)"), f"file://{tmp_path}/rows.json")
    assert [r["i"] for r in json.loads((tmp_path / "rows.json").read_text())] == [3, 90]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["rows.json"]


def test_no_rows_and_odd_columns(spark, tmp_path):
    sinks.write_json_array(spark.createDataFrame([], "i long"), f"{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    df = spark.createDataFrame([(1, 2)], "`a.b` int, value int")
    sinks.write_json_array(df, f"{tmp_path}/odd.json")
    assert json.loads((tmp_path / "odd.json").read_text()) == [{"a.b": 1, "value": 2}]


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    (tmp_path / "rows.json").write_text("[1]")
    bad = spark.range(10).selectExpr("if(id = 7, raise_error('lost'), id) AS id")
    with pytest.raises(Exception, match="lost"):
        sinks.write_json_array(bad, f"{tmp_path}/rows.json")
    assert (tmp_path / "rows.json").read_text() == "[1]"
    assert [p.name for p in tmp_path.iterdir()] == ["rows.json"]
