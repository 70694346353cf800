"""Clauses of files that several tasks read: the same as in whole texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlattice.functions import text as X
from normlattice.operators import extraction as E

PARTS = ["Provision 5.1-2 The device shall\nbe kept. ", "Provision 5.12-3A should\n\n\n\nstay ", "Provision\n5.3.1-4.2\nmay ", "Provision 5.3 alone ", "see Provision 6 and Provisions, ", "12 Heading\nlost ", "\n7 Next\n", "ETSI \n\n", "ETSI EN 303 645 V2.1.1 (2020-06)\n", "Provision ETSI\n5.4-1 x ", "\nNOTE 1: why ", "\nAnnex B\n", "Provision 5.9-9 ", "é words\n", " \n"]


@pytest.mark.parametrize("pattern, marker, after", [(E.CLAUSE_A, X.MARKER, 300), (E.CLAUSE_B, None, 0), (E.CLAUSE_A, X.MARKER, 0)])
def test_same_clauses_as_in_whole_texts(spark, tmp_path, pattern, marker, after):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(PARTS, n)) for n in (0, 1, 3, 8, 40, 40, 200, 200, 12, 12)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8")
    cleaned = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("text", X.clean_text(F.col("text")))
    if marker:
        cleaned = cleaned.withColumn("text", X.cut_at_marker(F.col("text"), marker, after))
    want = {}
    for r in E.clauses(cleaned, "text", pattern).orderBy("i", "pos").collect():
        want.setdefault(r.i, []).append((r.provision_id, r.body))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path / "7.txt"), lineSep=E.WORD).rdd.getNumPartitions() > 3
        found = E.clauses_of_files(spark, str(tmp_path), pattern, marker, after).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(found, key=lambda r: (r.file, r.pos)):
        got.setdefault(int(r.file.rsplit("/", 1)[1].split(".")[0]), []).append((r.provision_id, r.body))
    assert got == want and len(want) > 3


def test_sorted_pieces_have_no_file_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Provision 5.1-1 shall Provision 5.1-2 may", encoding="utf-8")
    out = E.clauses_of_files(spark, str(tmp_path), E.CLAUSE_A)
    assert [r.file.rsplit("/", 1)[1] for r in out.collect()] == ["a.txt"] * 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.split("\n") if "hashpartitioning(" in x and "file#" in x]
