import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlattice import schemas as S
from normlattice.functions import text as X
from normlattice.operators import evaluation, extraction, providers, similarity
from normlattice.plans import align
from normlattice.sources import readers, sinks
from normlattice.streaming import clauses as streaming

DOC_A = (
    "ETSI\n\n\n\nProvision 5.1-1 Devices shall have unique passwords.\nNOTE 1: more\nof it\n"
    "Provision 5.1-2A Users may choose.\n12 Next heading\nlost\n"
    "Provision 5.2-1 Void.\nProvision 5.2-2 We avoid it and\nvoid\n"
    "Provision 5.10-1 Vendors should say so.\nNOTE: stays\nProvision 5.99-1 Dismay only\n"
)
DOC_B = "Provision 5.1.1-1 Operators shall\x0c 7 train.\nProvision 5.1.1-1.2 Nobody else\r\n12 said so\nProvision 5.9.9-3 End.\n"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_clauses_of_both_kinds(spark):
    dim_a, dim_b = readers.dimension(spark, S.SECTIONS_A), readers.dimension(spark, S.SECTIONS_B)
    docs = spark.createDataFrame([(DOC_A, DOC_B)], "a string, b string")
    got = {r.provision_id: r for r in extraction.provisions_a(docs.select("a"), "a", dim_a).collect()}
    assert sorted(got) == ["5.1-1", "5.1-2A", "5.10-1", "5.99-1"]
    assert got["5.1-1"].text == "Devices shall have unique passwords."
    assert got["5.1-2A"].text == "Users may choose." and got["5.1-2A"].modality == "may"
    assert got["5.10-1"].text.endswith("NOTE: stays") and got["5.10-1"].title == "Examine system telemetry data"
    assert got["5.99-1"].title == "Unknown" and got["5.99-1"].modality == "may"  # inside a longer word
    got = {r.provision_id: r for r in extraction.provisions_b(docs.select("b"), "b", dim_b).collect()}
    assert got["5.1.1-1"].text == "Operators shall\x0c 7 train." and got["5.1.1-1"].modality == "shall"
    assert got["5.1.1-1.2"].text == "Nobody else\r\n12 said so" and got["5.1.1-1.2"].modality == "unknown"
    assert got["5.9.9-3"].text == "End." and got["5.9.9-3"].title == "Unknown"
    assert [f.name for f in extraction.provisions_a(docs.select("a"), "a", dim_a).schema] == S.PROVISION.names


def test_cleaning(spark):
    assert one(spark, " \x0cETSI  \n\nETSI EN 1 2 V1.2.3 (2020-01)\nx\n\n\n\ny ", X.clean_text) == "x\n\ny"
    cut = lambda c: X.cut_at_marker(c, "\nAnnex B", 5)
    assert one(spark, "a\nAnnex B\nAnnex B z", cut) == "a\nAnnex B"
    assert one(spark, "12345\nAnnex B", cut) == "12345" and one(spark, "none", cut) == "none"
    for text, want in (("b\nNOTE 1: x\ny", "b"), ("b\nNOTE : x", "b"), ("b\nNOTE: x", "b\nNOTE: x"), ("b\nEXAMPLE 12: x", "b")):
        assert one(spark, text, X.trim_explanations) == want
    for text, want in (("Void.", True), ("long enough to pass\nvoid", True), ("12345Void", True), ("x" * 20 + "Void", False), ("avoid", False)):
        assert one(spark, text, X.is_void) is want
    for text, want in (("should not, shall", "shall"), ("Should", "should"), ("dismay", "may"), ("no", "unknown")):
        assert one(spark, text, X.modality) == want


def test_keywords_stand_alone(spark):
    words = lambda c: X.keywords(c, ["hash", "token", "tls"])
    assert one(spark, "Token, hash; TLS token", words) == ["hash", "tls", "token"]
    assert one(spark, "étoken token1 _token tokens", words) == []


def test_labels(spark):
    cut = lambda cuts: lambda c: X.label_of(c.cast("double"), cuts)
    for s, want in (("0.15", "COMPLEMENTARITY"), ("0.35", "OVERLAP"), ("0.6", "EQUIVALENCE"), ("0.1499", "NO_RELATION")):
        assert one(spark, s, cut(S.LEXICAL_CUTS)) == want
    for s, want in (("0.5", "COMPLEMENTARITY"), ("0.7", "OVERLAP"), ("0.85", "EQUIVALENCE"), ("0.4", "NO_RELATION")):
        assert one(spark, s, cut(S.SEMANTIC_CUTS)) == want
    for s, want in ((" overlap\n", "OVERLAP"), ("Label: EQUIVALENCE.", "EQUIVALENCE"), ("complementarity, overlap", "OVERLAP"), ("SUBSUMPTION", "NO_RELATION"), ("", "NO_RELATION")):
        assert one(spark, s, X.parse_label) == want


A = [("a1", "token hash token password"), ("a2", "nothing here"), ("a3", "hash of the Größe token"), ("a4", None)]
B = [("b1", "password token hash"), ("b2", "the hash"), ("b3", "")]


def corpora(spark):
    return spark.createDataFrame(A, "id string, text string"), spark.createDataFrame(B, "id string, text string")


def test_jaccard(spark):
    a, b = corpora(spark)
    vocabulary = ["hash", "token", "password"]
    got = {(r.src_id, r.tgt_id): (r.score, r.shared_keywords) for r in similarity.jaccard_pairs(a, b, vocabulary, 0.5).collect()}
    assert got == {("a1", "b1"): (1.0, ["hash", "password", "token"]), ("a3", "b1"): (0.6667, ["hash", "token"]), ("a3", "b2"): (0.5, ["hash"])}
    swapped = {(r.tgt_id, r.src_id): r.score for r in similarity.jaccard_pairs(b, a, vocabulary, 0.5).collect()}
    assert swapped == {k: v[0] for k, v in got.items()}
    assert similarity.jaccard_pairs(a.limit(0), b, vocabulary).count() == 0
    # every row is an item, also one that shares its id with others or repeats
    twice = spark.createDataFrame([(5, "the token hash"), (5, "the token hash"), (5, "password"), (None, "hash")], "id int, text string")
    got = sorted(map(str, similarity.jaccard_pairs(twice, b, vocabulary, 0.1).select("src_id", "tgt_id", "score").collect()))
    want = [(5, "b1", 0.6667)] * 2 + [(5, "b2", 0.5)] * 2 + [(5, "b1", 0.3333), (None, "b1", 0.3333), (None, "b2", 1.0)]
    assert got == sorted(f"Row(src_id={i}, tgt_id={j!r}, score={s})" for i, j, s in want)


def brute_tfidf(stop):
    import re
    from collections import Counter

    docs = {}
    for k, t in A + B:
        ws = [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stop]
        docs[k] = Counter(ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])])
    n = len(docs)
    df = Counter(t for d in docs.values() for t in d)
    vec = {k: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items()} for k, d in docs.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    return {(i, j): sum(x * vec[j].get(t, 0) for t, x in vec[i].items()) / (norm[i] * norm[j] or 1) for i, _ in A for j, _ in B}


def test_tfidf_matches_the_formula(spark, monkeypatch):
    a, b = corpora(spark)
    want = brute_tfidf(["the", "of"])
    pairs = {(r.src_id, r.tgt_id): r.score for r in similarity.tfidf_pairs(a, b, ["the", "of"]).collect()}
    assert pairs == pytest.approx({k: v for k, v in want.items() if v >= 0.1}, abs=1e-4)
    grid = {(r.src_id, r.tgt_id): r.score for r in similarity.tfidf_grid(a, b, ["the", "of"]).collect()}
    assert grid == pytest.approx(want, abs=1e-4)
    # rows that share an id or repeat are compared each for itself
    again = similarity.tfidf_pairs(a.union(a.filter("id = 'a1'")), b, ["the", "of"]).filter("src_id = 'a1' and tgt_id = 'b1'").collect()
    assert len(again) == 2 and again[0].score == again[1].score <= 1
    for most in (similarity.MAX_POSTINGS, 0):
        monkeypatch.setattr(similarity, "MAX_POSTINGS", most)
        monkeypatch.setattr(similarity, "TERM_ROWS", 1 if most == 0 else similarity.TERM_ROWS)
        monkeypatch.setattr(similarity, "HOT_TERMS", 5 if most == 0 else similarity.HOT_TERMS)
        assert {(r.src_id, r.tgt_id): r.score for r in similarity.tfidf_pairs(a, b, ["the", "of"]).collect()} == pairs
    src, tgt, m = sinks.dense_matrix(similarity.tfidf_grid(a, b, ["the", "of"]))
    assert m[src.index("a1"), tgt.index("b1")] == pytest.approx(want["a1", "b1"], abs=1e-4)


def test_cosine_blocks_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None), (98, [0.0] * 8)], "id long, v array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): s for i in range(60) for j in range(60) if (s := float(u[i] @ u[j])) >= 0.4}
    for rows_each in (similarity.VECTOR_ROWS, 12):
        monkeypatch.setattr(similarity, "VECTOR_ROWS", rows_each)
        got = {(r.src_id, r.tgt_id): r.score for r in similarity.cosine_pairs(rows, rows, 0.4).collect()}
        assert got == pytest.approx(want, abs=1e-4)
    top = [r.score for r in similarity.ranked(similarity.cosine_pairs(rows, rows, 0.4), 5).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 5
    assert similarity.cosine_pairs(rows.limit(0), rows, 0.4).count() == similarity.cosine_pairs(rows, rows.limit(0), 0.4).count() == 0


def test_mean_pooling_and_norm(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0)], "id int, vector array<double>, mask int")
    assert similarity.mean_pooled(rows).first().vector == [2.0, 4.0]
    assert rows.select(X.l2_normalised(F.array(F.lit(0.0))).alias("z")).first().z == [0.0]


def test_providers(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} and more") for i in range(40)], "id int, text string")
    out = providers.embed(docs, lambda: providers.hashing_embedder(16)).collect()
    assert len(out) == 40 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in out)
    pauses, calls = [], []

    def service(fails):
        def call(text):
            calls.append(text)
            if len(calls) <= fails:
                raise OSError("busy")
            return [[1.0, 2.0]]

        return call

    assert providers.one_by_one(service(2), sleep=pauses.append)(["x"]) == [[1.0, 2.0]] and pauses == [10, 10]
    calls.clear()
    with pytest.raises(OSError):
        providers.one_by_one(service(3), sleep=pauses.append)(["x"])
    with pytest.raises(ValueError):
        providers.one_by_one(lambda t: [[1.0], [2.0]], attempts=1)(["x"])
    with pytest.raises(ValueError):
        providers.embedder_for("other", None, None)
    assert providers.embedder_for("direct", "s", "b") == "s" and providers.embedder_for("batch", "s", "b") == "b"


def test_jobs(spark):
    class Job:
        def __init__(self, state):
            self.state = state

    states = iter(["RUNNING", "RUNNING", "JOB_STATE_SUCCEEDED"])
    assert providers.wait_for_job(lambda: Job(next(states)), sleep=lambda s: None).state == "JOB_STATE_SUCCEEDED"
    with pytest.raises(RuntimeError):
        providers.wait_for_job(lambda: Job("JOB_STATE_EXPIRED"))
    now = iter(range(0, 1000, 40))
    with pytest.raises(TimeoutError):
        providers.wait_for_job(lambda: Job("RUNNING"), max_wait_seconds=60, clock=lambda: next(now), sleep=lambda s: None)
    assert providers.embeddings_of([{"embedding": {"values": [1]}}, {"embeddings": [[2]]}], 2) == [[1], [2]]
    for bad in ([{"error": "no"}], [{}], []):
        with pytest.raises((RuntimeError, ValueError)):
            providers.embeddings_of(bad, 1)


def test_batch_jobs_label_and_embed(spark):
    class Done:
        state = "JOB_STATE_SUCCEEDED"

        def __init__(self, responses):
            self.responses = responses

    made = providers.batch_embedder(lambda requests: requests, lambda job: Done([{"embedding": {"values": [len(r["content"]), 1.0]}} for r in job]))
    assert made(["ab", ""]) == [[2, 1.0], [0, 1.0]] and made([]) == []

    def load():
        class Ended:
            state = "JOB_STATE_SUCCEEDED"

            def __init__(self, job):
                text = lambda r: r["contents"][0]["parts"][0]["text"]
                self.responses = [{"error": "refused"} if "no" in text(r) else {"response": {"text": f"It is {text(r)}"}} for r in job]

        return providers.batch_labeller(lambda requests: requests, Ended)

    pairs = spark.createDataFrame([(1, "a", "x", "overlap"), (2, "b", "x", "no equivalence"), (3, "c", "x", "equivalence")], "pair_id int, src_id string, tgt_id string, q string")
    got = {r.src_id: r.predicted_rel for r in providers.label_all(pairs, F.col("q"), load, "m").collect()}
    assert got == {"a": "OVERLAP", "b": "NO_RELATION", "c": "EQUIVALENCE"}


def test_console_and_counts(spark):
    lines = []
    sinks.console(spark.createDataFrame([(1, 0.5)], "id int, score double"), "Top", show=lines.append)
    assert lines == ["Top: id, score", "  1, 0.5000"]
    df, seen = evaluation.counted(spark.range(10), "ten", even="id % 2 = 0")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_answers(spark):
    pairs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "d", "x")], "pair_id int, src_id string, tgt_id string")
    parts = '{"candidates": [{"content": {"parts": [{"text": "OVER"}, {"text": "LAP"}]}}]}'
    answers = spark.createDataFrame([(3, '{"text": "equivalence"}', None), (1, parts, None), (2, '{"text": "OVERLAP"}', "failed")], "pair_id int, response string, error string")
    got = {r.src_id: r.predicted_rel for r in providers.label_pairs(pairs, answers, "m").collect()}
    assert got == {"a": "OVERLAP", "b": "NO_RELATION", "c": "EQUIVALENCE", "d": "NO_RELATION"}
    rows = spark.createDataFrame([('{"embedding": {"values": [1, 2]}}',), ('{"embeddings": [{"values": [3]}, {"values": [4]}]}',)], "r string")
    assert [r.e for r in rows.select(X.response_embeddings(F.col("r")).alias("e")).collect()] == [[[1.0, 2.0]], [[3.0], [4.0]]]


def test_sources_and_sinks(spark, tmp_path):
    truth = readers.inline_truth(spark, [("5.1-1", "5.1.1-1", "SUBSUMPTION_A_BROADER", 'says "so", twice', 3)])
    sinks.write_csv(truth, f"{tmp_path}/truth")
    back = readers.read_truth(spark, f"{tmp_path}/truth").first()
    assert back.justification == 'says "so", twice' and back.relationship_merged == "SUBSUMPTION" and back.confidence == 3
    preds = spark.createDataFrame([("a", "b", 0.5, ["x", "y"], "OVERLAP")], "src_id string, tgt_id string, jaccard_score double, shared_keywords array<string>, predicted_rel string")
    sinks.write_csv(preds, f"{tmp_path}/jaccard")
    found, missing = readers.read_all_predictions(spark, {"jaccard": f"{tmp_path}/jaccard", "encoder": f"{tmp_path}/none"})
    assert missing == ["encoder"] and found.first().score == 0.5
    assert spark.read.csv(f"{tmp_path}/jaccard", header=True).first().shared_keywords == "['x', 'y']"
    with pytest.raises(ValueError):
        readers.require(preds, "nope")
    with pytest.raises(FileNotFoundError):
        readers.read_summary(spark, f"{tmp_path}/none")
    provisions = spark.createDataFrame([("5.1-1", "EN", "5.1", "Tïtle", "t", "shall")], S.PROVISION)
    sinks.write_json_array(provisions, f"{tmp_path}/p.json")
    assert readers.read_provisions(spark, f"{tmp_path}/p.json").first().title == "Tïtle"
    assert readers.without_void(provisions).count() == 1
    marked = provisions.withColumn("is_void", F.lit(True))
    assert readers.without_void(marked).count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text(DOC_A)
    assert readers.load_standard(readers.read_documents(spark, f"{tmp_path}/d")).first().text.startswith("Provision")
    assert [r.text for r in readers.read_pdfs(spark, f"{tmp_path}/d", ("cat",)).collect()] == [DOC_A]
    (tmp_path / "env").write_text("# no\nexport MODEL_MODE=' Batch '\nMODEL_API_KEY=\"k\"\n")
    config = readers.ModelConfig.from_env(readers.read_env_file(f"{tmp_path}/env"), need_key=True)
    assert (config.mode, config.api_key, config.max_retries) == ("batch", "k", 3)
    with pytest.raises(ValueError):
        readers.ModelConfig.from_env({}, need_key=True)


def test_the_whole_job(spark, tmp_path):
    docs = spark.createDataFrame([(DOC_A, DOC_B + "Provision 5.1.2-1 Devices shall have unique passwords.\n")], "a string, b string")
    a = extraction.provisions_a(docs.select("a"), "a", readers.dimension(spark, S.SECTIONS_A))
    b = extraction.provisions_b(docs.select("b"), "b", readers.dimension(spark, S.SECTIONS_B))
    preds = align.predictions(a, b, stop_words=["the"], embedders={"sentence": lambda: providers.hashing_embedder(32)})
    truth = spark.createDataFrame([("5.1-1", "5.1.2-1", "EQUIVALENCE"), ("5.1-2A", "5.9.9-3", "NO_RELATION")], "src_id string, tgt_id string, relationship string")
    methods = spark.createDataFrame([("tfidf",), ("jaccard",), ("sentence",)], "method string")
    out = align.evaluate(truth, preds, methods)
    f1 = {r.method: r.f1 for r in out["detection"].collect()}
    assert f1 == {"tfidf": 1.0, "sentence": 1.0, "jaccard": 0.0}
    sinks.write_metrics(out["summary"], f"{tmp_path}/m")
    assert readers.read_summary(spark, f"{tmp_path}/m").count() == 3


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(DOC_A)
    docs = streaming.arriving_documents(spark, f"{tmp_path}/in")
    q = streaming.write_provisions(docs, readers.dimension(spark, S.SECTIONS_A), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
