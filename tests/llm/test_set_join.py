import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from normlattice import session
from normlattice.llm import common, set_join, simhash, url_filter


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_roots(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def made(rng):
    """Texts with copies of any similarity, chains of edits and a line that many share."""
    vocabulary = ["".join(chr(97 + i) for i in rng.integers(0, 26, 5)) for _ in range(400)]
    prose = lambda k: [vocabulary[i] for i in rng.integers(0, 400, k)]
    line, out = prose(12), []
    for k in range(60):
        text = prose(rng.integers(8, 120)) + (line if k % 3 == 0 else [])
        out.append(text)
        for _ in range(rng.integers(0, 8)):
            text = list(out[-1] if rng.random() < 0.5 else text)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(0, len(text))] = prose(1)[0]
            out.append(text)
    return [" ".join(t) for t in out] + [None, "", " ", "one two", "ONE  two", "a b c d " * 50, "a b c d " * 70, " ".join(line)]


@pytest.mark.parametrize("tight", [False, True])
def test_components_match_brute_force(spark, monkeypatch, tight):
    if tight:  # hot shingles, components in blocks, joins by a shuffle
        monkeypatch.setattr(set_join, "HOT", 4)
        monkeypatch.setattr(set_join, "CLUSTER_SETS", 3)
        for m in (common, url_filter, session):
            monkeypatch.setattr(m, "MAX_BROADCAST", 3)
        monkeypatch.setattr(session.small, "__defaults__", (3,))
    texts = made(np.random.default_rng(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = {}, {}
    for r in simhash.similar_texts(docs).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    for i, r in enumerate(brute_roots(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("paired", [1, 3, 8])
def test_components_match_brute_force_with_frequent_shingles(spark, monkeypatch, paired):
    monkeypatch.setattr(set_join, "PAIRED", paired)
    texts = made(np.random.default_rng(10 + paired))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = {}, {}
    for r in simhash.similar_texts(docs).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    for i, r in enumerate(brute_roots(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_texts_that_share_a_little_with_each_neighbour_are_apart(spark):
    rng = np.random.default_rng(4)
    prose = lambda k: ["".join(chr(97 + i) for i in rng.integers(0, 26, 6)) for _ in range(k)]
    both = [prose(120) for _ in range(41)]
    texts = [" ".join(both[i] + prose(360) + both[i + 1]) for i in range(40)]
    texts += [f"{texts[i]} {prose(1)[0]}" for i in range(0, 40, 8)]
    raws = spark.createDataFrame([(t.encode(),) for t in texts], "raw binary")
    links = set_join.candidate_links(raws, set_join.frequent(raws))
    sizes = [r["count"] for r in common.connected_components(links).groupBy("root").count().collect()]
    assert sizes == [2] * 5  # what texts have in common with two others together made one component of all


def test_pairs_of_a_shingle_over_any_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted({(int(h), int(n), int(k)) for h, n, k in zip(rng.integers(0, 12, 150), rng.integers(8, 14, 150), rng.integers(-40, 40, 150), strict=True)})
    want = {}
    for i, (h, n, k) in enumerate(rows):
        for g, m, j in rows[:i]:
            if g == h and 5 * m >= 4 * n:
                want[min(j, k), max(j, k), m] = want.get((min(j, k), max(j, k), m), 0) + 1
    for step in (1, 7, 1000):
        parts = [pa.record_batch([pa.array([r[0] for r in p], pa.int64()), pa.array([r[2] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.int32())], ["h", "key", "size"]) for p in (rows[at : at + step] for at in range(0, len(rows), step))]
        got = {}
        for b in set_join._pairs(iter(parts)):
            for r in b.to_pylist():
                got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["n"]
        totals = {}
        for (a, b, _), n in want.items():
            totals[a, b] = totals.get((a, b), 0) + n
        assert got == totals
    assert sum(b.num_rows for b in set_join._pairs(iter([]))) == 0


@pytest.mark.parametrize("listed", [common.MAX_BROADCAST, 0])
def test_stage_links_edited_copies(spark, monkeypatch, listed):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", listed)  # 0: by the Bloom filter
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, 6))
    rows = []
    for i in range(40):
        text = [word() for _ in range(50)]
        edited = [*text[:25], word(), *text[26:]] if i % 2 else [*text, word(), word(), word()]
        rows += [(i, " ".join(text)), (1000 + i, " ".join(edited)), (2000 + i, " ".join(text[:25] + [word() for _ in range(25)]))]
    rows += [(5, rows[15][1]), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*range(40), *range(2000, 2040), None], key=str)
    assert simhash.keep_one_per_group(docs.limit(0), width=5, exact=True).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if re.fullmatch("shuffle_.*data", x)}

    before, ends = shuffled(), time.time() + 10
    common.materialise(spark.range(100_000).groupBy(F.xxhash64("id").alias("h")).count(), "clean")
    while shuffled() - before and time.time() < ends:
        time.sleep(0.1)
    assert not shuffled() - before


def test_long_lists_move_only_rows_that_may_match(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 3)
    rows = spark.range(1000).selectExpr("id AS k", "concat('text ', id) AS text")
    table = common.materialise(spark.range(0, 1000, 50).selectExpr("id AS k", "id * 2 AS twice"), "table")
    got = url_filter.matched(rows, table, "k")
    assert got.columns == ["k", "text", "twice"]
    assert sorted(map(tuple, got.collect())) == [(i, f"text {i}", 2 * i) for i in range(0, 1000, 50)]
    assert url_filter._sifted(rows, table, "k", "k", 20)[0].count() < 200
