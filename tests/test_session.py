import os
import subprocess
import sys

from normlattice import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_small_and_scratch(spark):
    df = spark.range(5)
    assert "BROADCAST" in session.small(df)._jdf.queryExecution().toString().upper()
    assert session.small(df, 4) is df
    path = session.scratch_dir(spark).removeprefix("file:").replace("//", "/", 1)
    before = set(os.listdir(path))
    again = session.materialise(df, "five")
    assert again.columns == ["id"] and again.count() == 5
    assert any(x.startswith("five-") for x in set(os.listdir(path)) - before)
    assert session.clear_scratch(spark) >= 1 and not any(x.startswith("five-") for x in os.listdir(path))


def test_queries_run_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/scratch").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(100)], "vec_id long, embedding array<float>").write.parquet("{tmp_path}/sf/embeddings.parquet")
import __spark_entry__
print("ROWS", __spark_entry__.queries()["topk_pairs"](spark, "{tmp_path}/sf").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 10" in done.stdout, done.stderr[-2000:]


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', len(e.queries()), sorted(e.oracle_sql())[:1])"], cwd=copy, capture_output=True, text=True, timeout=120)
    done = run()
    assert "NAMES" in done.stdout and "op1" not in done.stdout, done.stderr
    # a package that is there but broken is an error
    (copy / "normlattice" / "llm").mkdir()
    (copy / "normlattice" / "llm" / "__init__.py").write_text("")
    (copy / "normlattice" / "llm" / "queries.py").write_text("import nothing_of_that_name\n")
    assert run().returncode != 0
