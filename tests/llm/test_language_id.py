import numpy as np
import pytest
from pyspark.sql import functions as F

from normlattice.llm import language_id as L

SYLLABLES = {"aa": "ba do ki mu ne", "bb": "sch tz ein ung ver", "cc": "ção não ler ões", "dd": "дом кни ест ого"}
SCHEMA = "doc_id long, text string, lang string, score double, rejected string"


def made(n, seed, words=(1, 60)):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[rng.integers(4)]
        parts = SYLLABLES[lang].split()
        word = lambda: "".join(parts[rng.integers(len(parts))] for _ in range(rng.integers(2, 5)))
        rows.append((i, " ".join(word() for _ in range(rng.integers(*words))), lang, 0.0, "x"))
    return rows


def brute(text):
    """Subwords of a text, from its definition."""
    raw = L.normal(text)
    return sorted(raw[i : i + n] for n in L.SIZES for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1] and raw[i : i + n].strip())


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_subwords(monkeypatch, piece):
    monkeypatch.setattr(L, "SLICE_BYTES", piece)
    assert L.normal("1 2.—") == L.normal("") == b"" and L.normal("a1É") == " a é ".encode()
    for text in ("a", "Ab, cd! 12 é", "word " * 9, "中文 字", "x" * 40):
        at, share = L.counted(L.normal(text))
        want = np.zeros(L.BUCKETS)
        grams = brute(text)
        for g in grams:
            found, _ = L.subwords(np.frombuffer(g, np.uint8), 1)
            want[found[-1]] += 1 / len(grams)
        assert np.allclose(want[at], share) and abs(share.sum() - 1) < 1e-5


def test_held_out_accuracy_and_cases(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = L.fit(docs.filter(~L.held_out(F.col("doc_id"))), per_language=120)
    assert model.languages == sorted(SYLLABLES)
    fresh = made(400, 2) + [(None, None, "aa", 0.0, None), (7, "", "aa", 0.0, None), (8, "12 — ☃ 3", None, 0.0, None), (9, "Ungver " * 400_000, "bb", 0.0, None), (9, "x", None, 0.0, None), (9, "x", None, 0.0, None)]
    got = L.identify(spark.createDataFrame(fresh, SCHEMA), model).collect()
    assert len(got) == len(fresh) and got[0].__fields__ == ["doc_id", "lang_pred", "score", "rejected"]
    assert np.mean([g.lang_pred == r[2] for g, r in zip(got[:400], fresh)]) > 0.98
    assert all(0 <= g.score <= 1 for g in got)
    assert [(g.lang_pred, g.score) for g in got[400:403]] == [("und", 0.0)] * 3
    assert got[403].lang_pred == "bb" and got[404] == got[405] and got[404].lang_pred in SYLLABLES
    # what resembles no language scores less than what does, and the same model comes out again
    odd = L.identify(spark.createDataFrame([(1, "qqxx wwyy jjvv qxqx", None, 0.0, None)], SCHEMA), model).first()
    assert odd.score < np.median([g.score for g in got[:400]])
    again = L.fit(docs.repartition(5).filter(~L.held_out(F.col("doc_id"))), per_language=120)
    assert np.array_equal(again.logits, model.logits) and again.threshold == model.threshold


def test_batches_agree_and_nothing_to_learn(spark):
    model = L.Model(["a", "b"], np.random.default_rng(0).normal(size=(L.BUCKETS, 2)).astype(np.float32), np.zeros(2), 0.5)
    texts = [r[1] for r in made(50, 4)] + ["", "z" * 3000]
    assert np.allclose(model.probabilities(texts), np.concatenate([model.probabilities([t]) for t in texts]), atol=1e-5)
    docs = spark.createDataFrame([(1, "words", None, 0.0, None), (2, None, "en", 0.0, None)], SCHEMA)
    for table in (docs, docs.limit(0)):
        none = L.fit(table)
        assert none.languages == []
        assert {(r.lang_pred, r.score, r.rejected) for r in L.identify(docs, none).collect()} == {("und", 0.0, True)}
    assert L.identify(docs.limit(0), none).count() == 0


def test_calibration():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(4000, 3))
    p = L.softmax(2.5 * z)
    y = np.array([rng.choice(3, p=r) for r in p])
    t, threshold = L.calibrate(z, y)
    assert 0.3 < t < 0.5
    q = L.softmax(z / t)
    sure = q.max(1) >= threshold
    assert (q.argmax(1) == y)[sure].mean() >= L.ACCURACY and 0 < sure.mean() < 1
