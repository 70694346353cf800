import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from normlattice.llm import divergence

SCHEMA = "lang string, source string, text string, value string, rank int"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top=10):
    docs = [((lang or ""), (source or ""), [w.translate(UPPER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if df[w] >= min_docs)
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        for a in counts:
            pa = p(counts[a])
            pairs = [(b, sum(f(pa[w], x) for w, x in p(counts[b]).items())) for b in counts if b != a]
            terms = [(w, f(pa[w], q[w])) for w in kept if counts[a][w] and pa[w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, w, v, i) for i, (w, v) in enumerate(items[:most], 1)]
    return sorted(out)


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = ["Ab", "c1d", "éÉ", "x", "ÀB", "中文", "zz-y", " q", "the", "of"]
    # a third of all rows are one source's
    return [
        (
            [None, "", "en", "en", "de"][rng.integers(5)],
            None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"s{rng.integers(7)}",
            None if rng.random() < 0.1 else " ".join(words[min(9, int(rng.exponential(3)))] for _ in range(rng.integers(0, 12))),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("bins, block, piece", [(1 << 15, 32, 1 << 24), (3, 2, 16)])
def test_equals_brute_force(spark, monkeypatch, bins, block, piece):
    rows = made(300, 3) + [("fr", "only", "a b"), ("it", "a", None), ("it", "b", "une"), ("en", "big", "The  oF " * 50)] * 2
    monkeypatch.setattr(divergence, "BIN_TERMS", bins)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergence, "SLICE_BYTES", piece)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = divergence.audit(docs, min_docs=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_slices_and_empty_table(spark, monkeypatch):
    raw = b"Abc d\xc3\xa9 " * 40 + b"tail"
    monkeypatch.setattr(divergence, "SLICE_BYTES", 7)
    assert [w for p in divergence._pieces(raw) for w in p] == raw.lower().split()
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    # no term is kept: pairs of value 0
    docs = spark.createDataFrame([("en", "a", "x", None, 1), ("en", "b", None, None, 1)], SCHEMA)
    assert sorted((r.source, r.item, r.value, r.rank) for r in divergence.audit(docs).collect()) == [("a", "b", 0, 1), ("b", "a", 0, 1)]
