import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from hashlib import sha256  # noqa: E402

import numpy as np  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from normlattice.llm import bpe, tokens  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["ΟΔΥΣΣΕΥΣ Σ", "İstanbul Ǆ", "a<|endoftext|>b <|startoftext|>", "\x1c\x1f a\x85b", "é ́x", "ﬁ Ⅷ ½ 漢字 12345", "", " ", "\n\n a \n", "😀👨‍👩‍👧", "it's I'LL we'Re", "x" * 500 + "y", "no\tbreak " * 900, "漢" * 3000, "é" * 5000 + " x", "a1b2c3" * 700, "<|endoftext|>" * 300, "'s'store" * 400]
text = st.text(st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \n\tabcß'<|>endoftext")), max_size=300)


@settings(max_examples=60, deadline=None)
@given(text)
def test_counts_and_splices_like_the_library(x):
    want = _lib(BYTES).encode(x, add_special_tokens=False).ids
    assert tokens.Counter.of(BYTES).count(x) == len(want)
    assert _small().ids(x) == want and _small().count(x) == len(want)


@settings(max_examples=60, deadline=None)
@given(text)
def test_bpe_is_the_library_s(x):
    want = _lib(WORDS).encode(x, add_special_tokens=False).ids
    got = bpe.Codec.of(WORDS).encode(x)
    assert got.tolist() == want
    assert bpe.Codec.of(WORDS).decode(got) == _lib(WORDS).decode(want, skip_special_tokens=False)


_made = {}


def _lib(path):
    if path not in _made:
        _made[path] = Tokenizer.from_file(path)
    return _made[path]


def _small():
    if "small" not in _made:
        _made["small"] = tokens.Counter(BYTES, chunk=70, overlap=56)
    return _made["small"]


def test_queries_on_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "x"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(map(tuple, tokens.count_tokens(docs, BYTES).collect()), key=str)
    n = [len(_lib(BYTES).encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted([(i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n)], key=str)
    got = sorted(map(tuple, bpe.digests(docs, WORDS).collect()), key=str)
    want = []
    for i, t in rows:
        ids = _lib(WORDS).encode(t or "", add_special_tokens=False).ids
        back = _lib(WORDS).decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, WORDS).filter("doc_id = 5").collect()}
    assert ids[5] == _lib(WORDS).encode(ODD[5], add_special_tokens=False).ids
    assert tokens.count_tokens(docs.limit(0), BYTES).count() == 0
    assert bpe.digests(docs.limit(0), WORDS).count() == 0


def test_other_patterns_take_whole_texts():
    assert not tokens.Counter(WORDS).splits
    assert tokens.Counter(WORDS).count("It's two") == len(_lib(WORDS).encode("It's two", add_special_tokens=False).ids)


@pytest.mark.parametrize("unit", ["漢字仮名交文章長短。", "слово, ", "ééàü— ", "1٣४!", "中文，"])
def test_production_chunks_of_long_texts_in_other_scripts(unit):
    rng = np.random.default_rng(1)
    x = "".join(np.array(list(unit * 2))[rng.permutation(2 * len(unit))].tobytes().decode("utf-32-le") for _ in range(100_000 // (2 * len(unit))))
    own = tokens.Counter(BYTES)
    seen = []
    encode = own._encode
    own._encode = lambda t: (seen.append(len(t)), encode(t))[1]
    assert own.count(x) == len(_lib(BYTES).encode(x, add_special_tokens=False).ids)
    assert max(seen) <= 4 * tokens.CHUNK and sum(seen) < 1.3 * len(x)
