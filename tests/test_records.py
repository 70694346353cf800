"""JSON arrays and CSV read by several tasks a file."""

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import types as T

from normlattice.sources import readers, records, sinks

ODD = ['"', "\\", "}", "{", "]", "[", ",", "\n", "\\\\", '\\"', "é", "日", "a b", "]}", '"}', "\r\n", "\t", "//"]


def made(n, seed):
    rng = np.random.default_rng(seed)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(ODD, rng.integers(0, 12)))
    return [(i, text(), text()) for i in range(n)]


@pytest.fixture
def narrow(spark, monkeypatch):
    """Splits of a few hundred bytes and chunks of fewer."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    monkeypatch.setattr(records, "CHUNK", 90)
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


JSON = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", T.StringType()), T.StructField("n", T.StructType([T.StructField("b", T.ArrayType(T.StringType()))]))])


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_of_one_file_by_many_tasks(narrow, tmp_path, indent):
    rows = made(150, 1)
    path = tmp_path / "a.json"
    path.write_text("﻿" * (indent or 0 > 0) + json.dumps([{"i": i, "a": a, "n": {"b": [b, "}"]}} for i, a, b in rows], indent=indent, ensure_ascii=False), encoding="utf-8")
    assert narrow.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 5
    got = records.read_json_array(narrow, str(path), JSON)
    assert sorted((r.i, r.a, r.n.b[0]) for r in got.collect()) == rows
    assert sorted(r.row for r in records.json_records(narrow, str(path)).select("row").collect()) == list(range(150))


def test_json_kinds_of_files(narrow, tmp_path):
    for name, text in {"empty": "", "none": "[ ]", "one": '{"i": 1, "a": "x"}', "lines": '{"i": 2}\n{"i": 3}\n', "mixed": '[1, "}", [], {"i": 4, "n": {"b": []}}, null]', "bad": '[{"i": "x"}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = records.read_json_array(narrow, str(tmp_path), JSON).collect()
    assert sorted(r.i or 0 for r in got) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_of_one_file_by_many_tasks(narrow, tmp_path, end):
    rows = [(str(i), (a or "").replace("\r", ""), (b or "").replace("\r", "")) for i, a, b in made(120, 2)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows([("k", "a", "b"), *rows])
    path = tmp_path / "a.csv"
    path.write_bytes(b"\xef\xbb\xbf" + out.getvalue().rstrip("\r\n").encode())
    assert narrow.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 3
    got = records.numbered(records.read_csv(narrow, str(path))).orderBy("number").collect()
    assert [(r.k, r.a or "", r.b or "") for r in got] == rows
    assert [r.number for r in got] == list(range(120)) == [r.ord.row - 1 for r in got]


def test_last_prediction_wins_over_splits(narrow, tmp_path):
    lines = ["src_id,tgt_id,m_score,predicted_rel"] + [f's{i % 5},t,0.{i % 10},"L{i}"' for i in range(200)]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    got = readers.read_predictions(narrow, str(tmp_path / "p.csv"), "m").collect()
    last = {k: max((r.ord, r.predicted_rel) for r in got if r.src_id == k)[1] for k in {r.src_id for r in got}}
    assert last == {f"s{k}": f"L{195 + k}" for k in range(5)}


def test_marked_clauses_go_and_arrays_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), None if i == 4 else 'x "]}', True if i % 3 == 0 else None) for i in range(20)], "provision_id string, text string, is_void boolean").repartition(4)
    sinks.write_json_arrays(rows, str(tmp_path / "arrays"))
    files = list((tmp_path / "arrays").glob("part-*"))
    assert len(files) > 1 and sum(len(json.loads(f.read_text())) for f in files if f.stat().st_size) == 20
    kept = readers.without_void(readers.read_provisions(spark, str(tmp_path / "arrays")))
    assert "is_void" not in kept.columns
    assert sorted(int(r.provision_id) for r in kept.collect()) == [i for i in range(20) if i % 3]
    sinks.write_json_arrays(rows.limit(0), str(tmp_path / "nothing"))
    assert readers.read_provisions(spark, str(tmp_path / "nothing")).count() == 0


def test_a_worker_makes_few_rows_objects_at_once(spark):
    import pyarrow as pa

    from normlattice.sources import records

    assert records.CHUNK <= 1 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 1000), pa.array([0] * 1000), pa.array(["x" * 9] * 1000)], ["file", "start", "value"])
    assert list(records._few(iter([batch]), 64)) == [("f", 0, "x" * 9)] * 1000
