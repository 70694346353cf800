import numpy as np

from normlattice import session
from normlattice.llm import decontam


def brute_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = 2 if item[i - 1] == text[j - 1] else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 25))
        score, a, e = decontam.align(item, text)
        assert score == brute_align(item.tolist(), text.tolist())
        if score:
            assert brute_align(item.tolist(), text[a:e].tolist()) == score


WORDS = [f"w{i}" for i in range(400)]


def make(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [WORDS[i] for i in rng.integers(0, 400, n)]
    items = [say(n) for n in (40, 30, 16, 25)]
    docs = {}
    for k, it in enumerate(items):
        docs[10 + k] = say(200) + it + say(100)
        edited = [w if i % 7 else "edited" for i, w in enumerate(it)]
        docs[20 + k] = say(50) + edited[:10] + ["new"] + edited[10:] + say(10)
        docs[30 + k] = say(60) + it[:4] + say(60)  # a short quotation is no copy
        docs[40 + k] = say(300)
    rows = [(i, " ".join(w).upper() if i % 2 else ", ".join(w)) for i, w in docs.items()]
    rows += [(90, None), (91, ""), (None, " ".join(items[0])), (92, "İ " + " ".join(items[1])), (93, " ".join(say(50000) + items[2])), (94, "zz"), (94, "zz")]
    bench = [(k, " ".join(it)) for k, it in enumerate(items)] + [(7, None), (8, ""), (9, "zz"), (None, "--")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score"), spark.createDataFrame(bench, "item_id long, text string")


def test_copies_edited_copies_and_quotations(spark):
    docs, bench = make(spark)
    got = decontam.find_copies(docs, bench).collect()
    pairs = sorted([(r.doc_id, r.item_id) for r in got], key=str)
    want = [(10 + k, k) for k in range(4)] + [(20 + k, k) for k in range(4)] + [(None, 0), (92, 1), (93, 2), (94, 9), (94, 9)]
    assert pairs == sorted(want, key=str)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.score == 1:
            t = text[r.doc_id][r.start : r.end]
            assert len(decontam.WORD.findall(t)) == r.n_words
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([*range(30, 34), *range(40, 44), 90, 91])


def test_equals_an_alignment_of_all_pairs(spark):
    docs, bench = make(spark)
    want = []
    for d in docs.collect():
        for it in bench.collect():
            own, words = (decontam.WORD.findall((x or "").lower()) for x in (it.text, d.text))
            if own and words:
                number = {w: i + 1 for i, w in enumerate(dict.fromkeys(own))}
                score, _, _ = decontam.align(np.array([number[w] for w in own]), np.array([number.get(w, 0) for w in words]))
                if score >= decontam.least_score(len(own)) * 2 * len(own):
                    want.append((d.doc_id, it.item_id, round(score / (2 * len(own)), 9)))
    got = [(r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_copies(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_recall_of_edited_items():
    """30 % of the words replaced, lost or followed by another, in texts of like words."""
    rng = np.random.default_rng(17)
    found = []
    for _ in range(300):
        item = rng.integers(1, 3000, rng.integers(24, 60)).astype(np.uint64)
        copy = []
        for w in item:
            how = rng.integers(0, 3) if rng.random() < 0.3 else 3
            copy += [[rng.integers(1, 3000)], [], [w, rng.integers(1, 3000)], [w]][how]
        text = np.array([*rng.integers(1, 3000, 100), *copy, *rng.integers(1, 3000, 100)], np.uint64)
        places = np.arange(len(item) - 2)
        found.append(decontam.aligned(text, item, places, decontam.grams(text, 3), decontam.MIN_SCORE) is not None)
    assert np.mean(found) >= 0.9, np.mean(found)


def test_joins_by_shuffle_find_the_same(spark, monkeypatch):
    docs, bench = make(spark)
    one = sorted(map(str, decontam.find_copies(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 5)
    monkeypatch.setattr(decontam, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 16)
    monkeypatch.setattr(session.small, "__defaults__", (3,))
    assert sorted(map(str, decontam.find_copies(docs, bench).collect())) == one


def test_empty_tables(spark):
    docs, bench = make(spark)
    assert decontam.find_copies(docs.limit(0), bench).count() == 0
    assert decontam.find_copies(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
