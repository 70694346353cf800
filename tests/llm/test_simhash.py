import re

import numpy as np
import xxhash

from normlattice.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, budget=4):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= budget and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, "THE quick  brown\tfox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, " \n\t"),
    (6, "one two"),
    (7, "ÄÖÜ straße İx ſ"),
    (8, "a b c d " * 3000),
    (9, "a b c d " * 3000 + "e"),
    (None, "one two"),
    (6, "one two"),
    (6, "something else entirely is written here"),
]


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as root", "3 as a")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()), key=str)
    fps = [brute_print(t) for _, t in ROWS]
    root = brute_roots(fps)
    least = {}
    for (i, _), r in zip(ROWS, root):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    want = sorted(((i, f - (f >> 63 << 64), least[r]) for (i, _), f, r in zip(ROWS, fps, root)), key=str)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one_per_group(docs).count() == 0


def test_keep_one_per_group(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "7 as _at", "8 as _one_at")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == ["doc_id", "text", "_at", "_one_at"]
    assert {(r._at, r._one_at) for r in kept.collect()} == {(7, 8)}
    rows = sorted((r.doc_id, (r.text or "")[:9]) for r in kept.collect())
    assert rows == [(1, "The quick"), (3, ""), (6, "one two"), (6, "something"), (7, "ÄÖÜ straß"), (8, "a b c d a"), (9, "a b c d a")]


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    fps = []
    for x in base.tolist():
        for _ in range(10):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                y ^= 1 << b
            fps.append(y)
    return sorted(set(fps))


def test_trie_join_finds_every_link_also_in_split_units(spark):
    fps = planted(400, 1)
    root = brute_roots(fps)
    want = {}
    for f, r in zip(fps, root):
        want.setdefault(r, set()).add(f)
    want = sorted(map(sorted, want.values()))
    frame = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    for unit_rows in (simhash.UNIT_ROWS, 2):
        links = simhash.near_links(frame, unit_rows=unit_rows)
        pairs = [tuple(x % (1 << 64) for x in r) for r in links.collect()]
        assert all((a in fps and b in fps) for a, b in pairs)
        comp = {f: f for f in fps}

        def find(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for a, b in pairs:
            comp[max(find(a), find(b))] = min(find(a), find(b))
        got = {}
        for f in fps:
            got.setdefault(find(f), set()).add(f)
        assert sorted(map(sorted, got.values())) == want
