from hashlib import sha256

import numpy as np
import pytest

from normlattice.llm import sais, suffix_dedup


@pytest.mark.parametrize("small", [512, 0])
def test_suffix_array_by_brute_force(small, monkeypatch):
    monkeypatch.setattr(sais, "SMALL", small)
    rng = np.random.default_rng(1)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        assert sais.suffix_array(s, 5).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute(rows, length=100):
    """{(id, text): removed spans} over distinct rows in the order of dedup()."""
    kinds = sorted({(1 << 63) - 1 if i is None else i for i, _ in rows})
    assert len(kinds) == len(set(rows)), "the brute force needs different ids"
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (1 << 63) - 1 if r[0] is None else r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            x = raw[a : a + length]
            if x in seen:
                gone[a : a + length] = True
            seen.add(x)
        out[i, t] = gone
    return out


def wanted(rows):
    found = brute(rows)
    out = []
    for i, t in rows:
        raw, gone = np.frombuffer((t or "").encode(), np.uint8), found[i, t]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out.append((i, len(raw), int(gone.sum()), spans, sha256(raw[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def corpus():
    rng = np.random.default_rng(7)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(n))
    common, line = word(60), "é" * 70 + word(9)
    rows = [(k, word(rng.integers(0, 80)) + common[: rng.integers(90, len(common))] + word(5)) for k in range(0, 60, 2)]
    rows += [(k, rows[k // 4][1][:-20] + word(8)) for k in range(1, 60, 2)]
    rows += [(100, "a" * 500), (101, "b" * 99), (102, "b" * 100), (103, "ab" * 150), (104, line * 5), (105, word(3000)), (106, None), (107, ""), (None, common), (108, rows[0][1])]
    return rows


@pytest.mark.parametrize("hot", [64, 2])
def test_matches_brute_force(spark, monkeypatch, hot):
    rows = corpus()
    rows += [(108, rows[0][1])]  # a repeated row
    if hot == 2:  # closures carry module globals only by reference, so the combining step is driven directly below
        monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as raw", "2 as ord")
    assert got(suffix_dedup.dedup(docs)) == wanted(rows)


def test_hot_anchors_and_large_shards_through_spark(spark):
    rng = np.random.default_rng(11)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(n))
    passage = word(60)[:150]
    # a passage that many documents share, whole or cut, between words of their own; and long near copies
    rows = [(k, word(rng.integers(3, 20)) + passage[: int(rng.integers(60, 150))] + word(8)) for k in range(400)]
    long = word(1500)
    rows += [(1000 + k, long[: 40 * k] + "#" + str(k) + long[40 * k :]) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    raw = docs.selectExpr("doc_id as ord", "0L as tie", "cast(text as binary) as raw")
    kinds = {r.kind: r["count"] for r in raw.mapInArrow(suffix_dedup._anchor_rows, suffix_dedup.ROW).groupBy("kind").count().collect()}
    assert kinds[suffix_dedup.HOT] > 100 and kinds[suffix_dedup.SIGN] >= 1
    assert got(suffix_dedup.dedup(docs)) == wanted(rows)


def test_rows_that_share_an_id(spark):
    x = "".join(chr(97 + i * i % 23) + chr(97 + i // 7 % 26) for i in range(200))
    docs = spark.createDataFrame([(1, x), (1, x + "!"), (1, x), (2, x)], "doc_id long, text string")
    out = got(suffix_dedup.dedup(docs))
    assert sorted(r[2] for r in out if r[0] == 2) == [400]
    assert sorted(r[2] for r in out if r[0] == 1) in ([0, 0, 400], [0, 400, 400])


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_anchors_are_marked_in_a_batch():
    n = 200
    cols = [np.full(n, 5), np.arange(n) // 2, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)]
    kinds = suffix_dedup._combine(cols).column(0).to_pylist()
    assert [kinds.count(k) for k in (suffix_dedup.PLAIN, suffix_dedup.HOT, suffix_dedup.REPEAT, suffix_dedup.SIGN)] == [0, 100, 100, 1]


def test_long_runs_of_one_byte_stay_small(spark, monkeypatch):
    """A batch gives a row for each stretch of repeats, whatever their number, and holds COMBINE_ROWS of them."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "COMBINE_ROWS", 1 << 15)
    raw = b"x" * 200_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([raw])], ["ord", "tie", "raw"])
    rows = list(suffix_dedup._anchor_rows(iter([batch])))
    assert sum(b.num_rows for b in rows) < 20 < len(list(suffix_dedup.segments(raw))[0][0])
    docs = spark.createDataFrame([(1, "x" * 200_000), (2, "ab" * 60_000 + "x" * 150)], "doc_id long, text string")
    assert got(suffix_dedup.dedup(docs)) == wanted([(1, "x" * 200_000), (2, "ab" * 60_000 + "x" * 150)])
