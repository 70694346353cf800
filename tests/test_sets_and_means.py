"""Keyword sets that meet on rare words, and means of whole vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlattice.operators import similarity


def word(i):
    return "w" + "".join(chr(97 + int(d)) for d in str(i)) + "w"


def sets_of(spark, n, n_words, seed, start=0):
    rng = np.random.default_rng(seed)
    # some words are in most texts, others in few
    rate = np.linspace(0.02, 0.9, n_words) ** 2
    rows = [(start + i, " ".join(word(j) for j in np.flatnonzero(rng.random(n_words) < rate * rng.random()))) for i in range(n)]
    rows += [(start + 900, None), (start + 901, ""), (start + 902, "none of them"), rows[0], rows[0]] + [(start + 1000 + i, word(1)) for i in range(30)]
    return rows, spark.createDataFrame(rows, "id int, text string")


@pytest.mark.parametrize("threshold,n_words", [(0.05, 12), (0.8, 140), (1.0, 12), (1.5, 12)])
def test_sets_that_are_alike_are_all_found(spark, monkeypatch, threshold, n_words):
    monkeypatch.setattr(similarity, "SET_ROWS", 7)
    monkeypatch.setattr(similarity, "MAX_BROADCAST", 1000)
    (ra, a), (rb, b) = sets_of(spark, 60, n_words, 1), sets_of(spark, 70, n_words, 2, 5000)
    vocabulary = [word(i) for i in range(n_words)]
    own = lambda t: set((t or "").split()) & set(vocabulary)
    want = []
    for i, t in ra:
        for j, u in rb:
            x, y = own(t), own(u)
            if x & y and len(x & y) / len(x | y) >= threshold:
                want.append((i, j, round(len(x & y) / len(x | y), 4), sorted(x & y)))
    got = similarity.jaccard_pairs(a, b, vocabulary[::-1] + vocabulary[:3], threshold).collect()
    assert sorted((r.src_id, r.tgt_id, r.score, r.shared_keywords) for r in got) == sorted(want)
    assert bool(want) == (threshold <= 1)


def test_no_words_or_rows(spark):
    _, a = sets_of(spark, 5, 6, 1)
    assert similarity.jaccard_pairs(a, a, [], 0.5).count() == 0
    assert similarity.jaccard_pairs(a, a.limit(0), [word(1)], 0.5).count() == 0


def test_prefixes_leave_most_meetings_out(spark):
    n_words = 40
    vocabulary = sorted(word(i) for i in range(n_words))
    rows = [x for _, x in (sets_of(spark, 300, n_words, 1), sets_of(spark, 300, n_words, 2, 5000))]
    kinds = [x.select(*(c.alias(f"w{j}") for j, c in enumerate(similarity.bitmaps("split(text, ' ')", vocabulary)))).filter("w0 > 0").groupBy("w0").agg(F.count("*").alias("n_rows")) for x in rows]
    a, b = similarity._ranked_sets(kinds, vocabulary)
    pa, pb = similarity.prefixes(a, b, 1, n_words, 0.8)
    met = pa.join(pb, ["k", "tgt_size"]).count()
    every = a.crossJoin(b.select(F.col("r0").alias("o"))).filter(F.col("r0").bitwiseAND(F.col("o")) != 0).count()
    assert met < every / 10
    # rank 0 is the rarest word
    counts = [sum(r.r0 >> i & 1 for r in a.collect() + b.collect()) for i in range(n_words)]
    assert counts == sorted(counts)
    plan = similarity._set_pairs(a, b, 1, n_words, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan and not re.search("CartesianProduct|NestedLoop|Python", plan)


def test_means_of_vectors_with_holes_and_of_unequal_length(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        v = [float(x) for x in rng.normal(size=rng.choice([4, 4, 4, 2, 6]))]
        if i % 7 == 0:
            v[int(rng.integers(len(v)))] = None
        rows.append((["a", "b", None][i % 3], v if i % 11 else [None, []][i % 2], int(rng.integers(3)), "x"))
    rows += [("empty", [], 1, "x"), ("masked", [1.0], 0, "x"), ("unknown", [1.0], None, "x"), ("hole", [None, 2.0], 1, "x"), ("hole", [None], 1, "x")]
    df = spark.createDataFrame(rows, "id string, vector array<double>, mask int, size string").repartition(5)
    want = {}
    for k, v, m, _ in rows:
        for d, x in enumerate(v or []) if m else ():
            want.setdefault(k, {}).setdefault(d, []).extend([] if x is None else [x])
    got = {r.id: r.vector for r in similarity.mean_pooled(df).collect()}
    assert got.keys() == want.keys() and got["hole"] == [None, 2.0]
    for k, places in want.items():
        assert len(got[k]) == len(places)
        for d, xs in places.items():
            assert (got[k][d] is None) if not xs else got[k][d] == pytest.approx(np.mean(xs))
    assert similarity.mean_pooled(df.limit(0)).count() == 0
    plan = similarity.mean_pooled(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Generate" not in plan and "Python" not in plan
