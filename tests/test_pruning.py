"""Joins that prune: what they skip, and that nothing is lost."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlattice.operators import similarity


def corpus(spark, n, seed, start=0):
    """Texts over a few frequent words and many rare ones, some of them copies with edits."""
    rng = np.random.default_rng(seed)
    frequent, rare = ["the", "of", "and", "must"], [f"w{i}" for i in range(400)]
    shared = np.random.default_rng(0)
    rows, base = [], [[x for w in shared.choice(rare, 20) for x in (w, frequent[shared.integers(4)])] for _ in range(6)]
    for i in range(n):
        if i % 3 == 0:
            words = [w for w in base[i % 6] if rng.random() < 0.97 - 0.2 * (i % 2)]
        else:
            words = [x for w in rng.choice(rare, rng.integers(0, 25)) for x in (w, frequent[rng.integers(4)])]
        rows.append((start + i, " ".join(words) if words else None))
    return rows, spark.createDataFrame(rows, "id int, text string")


def brute(a, b):
    docs = []
    for _, t in a + b:
        ws = (t or "").split()
        docs.append(Counter(ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])]))
    n, df = len(docs), Counter(t for d in docs for t in d)
    vec = [{t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items()} for d in docs]
    unit = [{t: x / norm for t, x in v.items()} for v in vec for norm in [math.sqrt(sum(y * y for y in v.values())) or 1]]
    return {(str(a[i][0]), str(b[j][0])): sum(x * unit[len(a) + j].get(t, 0) for t, x in unit[i].items()) for i in range(len(a)) for j in range(len(b))}


@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.8])
def test_tfidf_signatures_lose_nothing(spark, monkeypatch, threshold):
    (ra, a), (rb, b) = corpus(spark, 40, 1), corpus(spark, 70, 2, 1000)
    want = {k: v for k, v in brute(ra, rb).items() if v >= threshold}
    assert want
    for most in (similarity.MAX_POSTINGS, 0):
        monkeypatch.setattr(similarity, "MAX_POSTINGS", most)
        monkeypatch.setattr(similarity, "TERM_ROWS", 3)
        got = {(r.src_id, r.tgt_id): r.score for r in similarity.tfidf_pairs(a, b, [], threshold).collect()}
        assert got == pytest.approx(want, abs=1e-4) and got.keys() == want.keys()


def test_tfidf_signatures_leave_frequent_terms_out(spark):
    (_, a), (_, b) = corpus(spark, 60, 3), corpus(spark, 60, 4, 1000)
    (wa, wb), norms = similarity._sides(a, b, [])
    unit = [w.filter("shared").join(n.drop("id"), "row").select("row", "term", "df", (F.col("w") / F.col("norm")).alias("u")) for w, n in zip((wa, wb), norms)]
    most = [x.groupBy("term").agg(F.max("u").alias("most")) for x in unit]
    sa, sb = (similarity.signatures(x, m, 0.35).cache() for x, m in zip(unit, reversed(most)))
    often = sa.groupBy("kept").agg(F.avg("df").alias("df"), F.count("*").alias("n")).collect()
    df = {r.kept: r.df for r in often}
    assert df[False] > 2 * df[True]
    meeting = sa.select("row", "term").join(sb.select(F.col("row").alias("peer"), "term"), "term")
    assert similarity.survivors(sa, sb, 0.35).count() < meeting.select("row", "peer").distinct().count() / 4
    # a row's rest grows along its terms, so its signature is their rarer part
    for r in sa.groupBy("row").agg(F.min(F.when(~F.col("kept"), F.col("df"))).alias("out"), F.max(F.when(F.col("kept"), F.col("df"))).alias("kept")).collect():
        assert r.out is None or r.kept is None or r.out >= r.kept


def vectors(spark, n, seed, start=0):
    """Unit vectors round a few directions, some of other lengths, null, empty, zero and repeated ones."""
    rng, centres = np.random.default_rng(seed), np.random.default_rng(9).normal(size=(5, 12))
    rows = [(start + i, [float(x) for x in centres[i % 5] + 0.15 * rng.normal(size=12)]) for i in range(n)]
    rows += [(start + n + i, [float(x) for x in rng.normal(size=k)]) for i, k in enumerate([3] * 8 + [12] * 3)]
    rows += [(start + 900, None), (start + 901, []), (start + 902, [0.0] * 12), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("threshold", [0.3, 0.9, -0.5])
def test_dense_blocks_that_are_skipped_hold_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "VECTOR_ROWS", 20)
    (ra, a), (rb, b) = vectors(spark, 80, 1), vectors(spark, 60, 2, 1000)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-9)
    want = sorted((i, j) for i, u in ra for j, v in rb if u and v and len(u) == len(v) and unit(u) @ unit(v) >= threshold)
    got = similarity.cosine_pairs(a, b, threshold).collect()
    assert sorted((r.src_id, r.tgt_id) for r in got) == want and want
    ua, ub = (similarity._units(x).filter("len > 0") for x in (a, b))
    pivots = similarity.pivots_of(ua, ub)
    ca, cb = (similarity.celled(x, pivots) for x in (ua, ub))
    table = similarity.ring_pairs(ca, cb, pivots, threshold).collect()
    rows = [[r.asDict() for r in x.collect()] for x in (ca, cb)]
    for r in table:
        cosines = [np.dot(x["v"], y["v"]) for x in rows[0] for y in rows[1] if (x["len"], x["cell"], x["ring"], y["len"], y["cell"], y["ring"]) == (r.len, r.a_cell, r.a_ring, r.len, r.b_cell, r.b_ring)]
        assert cosines and max(cosines) <= np.cos(r.least) + 1e-6
        assert r.kept or max(cosines) < threshold
    if threshold == 0.9:
        assert sum(not r.kept for r in table) > len(table) / 3


def test_rings_are_packed_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "VECTOR_ROWS", 20)
    _, a = vectors(spark, 300, 1)
    units = similarity._units(a).filter("len > 0")
    cells = similarity.celled(units, similarity.pivots_of(units, units))
    packed = similarity._packed(cells, "a").collect()
    for k in {r.len for r in packed}:
        own = [r for r in packed if r.len == k]
        # as many blocks as the rows of a length fill, however many rings they have
        assert {b for r in own for b in range(r["first"], r["last"] + 1)} == set(range(-(-sum(r.n for r in own) // 20)))
    assert len(packed) > len({(r.len, r["first"]) for r in packed})


def test_terms_are_told_once_for_each_chunk(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(similarity, "BUCKET_CHARS", 1500)
    (ra, a), (rb, b) = corpus(spark, 60, 1), corpus(spark, 150, 2, 1000)
    (ca, cb), _, rows, buckets = similarity._counted_sides(a, b, [])
    assert rows == 210 and buckets > 8 and cb.count() > 4
    assert sorted(x for r in cb.collect() for x in r.ids) == sorted(str(i) for i, _ in rb)
    _, found = similarity._frequencies([ca, cb], [])
    assert found.count() <= buckets * (ca.count() + cb.count())
    texts = [(t or "").split() for _, t in ra + rb]
    df = Counter(t for ws in texts for t in {*ws, *(f"{x} {y}" for x, y in zip(ws, ws[1:]))})
    (wa, wb), _ = similarity._sides(a, b, [])
    got = wa.unionByName(wb).select("term", "df").distinct().collect()
    assert {r.term: r.df for r in got} == df and len(got) == len(df)
