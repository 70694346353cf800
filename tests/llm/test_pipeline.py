import pytest

pytest.importorskip("public_tokenizers")

import numpy as np  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from normlattice.llm import bpe, queries  # noqa: E402

RNG = np.random.default_rng(4)


def prose(n):
    return " ".join("".join(chr(97 + i) for i in RNG.integers(0, 26, RNG.integers(2, 9))) for _ in range(n))


def test_stages_keep_what_they_should(spark, tmp_path):
    clean = {i: prose(80) for i in range(20)}
    item = prose(30)
    rows = [(i, t, "en", f"host{i % 4}", len(t)) for i, t in clean.items()]
    rows += [(30, "too short", "en", "host1", 9), (31, " ".join(["same words again"] * 60), "en", "host1", 0), (32, None, None, None, None), (None, prose(50), None, None, 1)]
    rows += [(40, clean[3], "en", "host0", 1), (41, clean[3].upper(), "en", "host0", 1)]
    rows += [(50, prose(40) + " " + item + " " + prose(20), "en", "host2", 1)]
    rows += [(60, prose(40) + ' password = "Zx81kQpw77" ' + prose(20), "en", "host2", 1)]
    rows += [(100 + i, "spam", "en", "bad", 4) for i in range(60)] + [(200, prose(60), "en", "bad", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = pipeline.materialise(stage(spark, docs, str(tmp_path)), "stage")
        if k < 4:
            assert out.columns == columns
        docs = out
        left.append({r.doc_id for r in out.select("doc_id").collect()})
        if name == "secret scans":
            r = out.filter("doc_id = 60").first()
            assert "[secret]" in r.text and "Zx81" not in r.text and r.n_chars == len(r.text)
            texts = {r.doc_id: r.text for r in out.collect()}
    kept = set(clean) | {None, 40, 41, 50, 60}
    assert left[0] == kept
    assert left[1] == kept - {40, 41}
    assert left[2] == left[3] == left[4] == kept - {40, 41, 50}
    codec = bpe.Codec.of(queries.tokenizer_path(pipeline.TOKENIZER))
    for r in docs.collect():
        assert r.ids == codec.encode(texts[r.doc_id]).tolist() and r.n_tokens == len(r.ids)
    assert pipeline.run(spark, str(tmp_path)).count() == len(left[4])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_do_not_reach_later_stages(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, prose), (2, prose + " more"), (3, "quite another text of a few words")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    left = pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in pipeline.token_stage(spark, left, "").collect()) == [1, 3]
