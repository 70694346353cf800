import hashlib
import zlib
from collections import defaultdict

import pytest

from normlattice.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, leaf string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(map(enc, (i, source, lang, n, text))))


def climb(nodes):
    """(root, proof of each node as a list of (place, others))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            at[k] = i // 16
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        i, text, lang, source, n = r[:5]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text is not None else None
        odd = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        own = leaf(i, text, lang, source, n)
        by[source].append((i is not None, i or 0, own, i, leaf(i, low, lang, source, n) if odd else own))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        tops[s] = climb([x[2] for x in by[s]])
    root, above = climb([tops[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for x, path in zip(by[s], tops[s][1]):
            folded = x[4]
            for i, others in path + up:
                folded = h("".join(others[:i] + [folded] + others[i:]))
            proof = h("".join(o for _, others in path + up for o in others))
            out.append((x[3], x[2], tops[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (700, 40), (300, 1)])
def test_equals_brute_force(spark, n, sources):
    rows = []
    for i in range(n):
        # half of all rows are one source's; sources of one leaf; ids twice and missing
        s = None if i % 7 == 3 and sources > 1 else "" if i % 11 == 5 and sources > 1 else "hot" if i % 2 or sources == 1 else f"s{i % sources}é"
        rows.append((None if i % 50 == 49 else i - i % 3 // 2, None if i % 13 == 12 else f"Text {i} É" * (i % 5), None if i % 9 == 0 else "en", s, None if i % 17 == 0 else i, "x", 1, "y"))
    if n > 16:
        rows += [rows[0]] * 20 + [(10**12, "LONG " * 100_000, "en", "hot", 1, "x", 1, "y")]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_empty_and_lost_children(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(RuntimeError):
        manifest._complete((0, 0), [(0, 3, b"a" * 32), (2, 3, b"b" * 32)])
    path = manifest.path_to(b"".join(bytes([i]) * 32 for i in range(3)), 1, b"")
    assert manifest.fold(b"\1" * 32, path) == manifest.digest_of(b"\0" * 32 + b"\1" * 32 + b"\2" * 32)
