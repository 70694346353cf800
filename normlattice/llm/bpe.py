"""BPE encoding and decoding with the vocabulary and merges of a public tokenizer.

A word's symbols form a doubly linked list; a priority queue holds the ranks of its neighbours'
merges, lowest rank and then leftmost first, and entries whose pair has changed since are skipped.
Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WHITE

#: Words that a worker remembers before it starts anew; longer ones are not remembered.
MEMO, MEMO_CHARS = 200_000, 64


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes like the tokenizers library with a file of the kind of word_bpe_49k.json."""

    _own: dict[str, Codec] = {}

    def __init__(self, path: str, memo: int = MEMO):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        added = spec.get("added_tokens", [])
        self.special = {a["content"]: a["id"] for a in added}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern.replace(r"\s", WHITE))
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = r
            self.made.append(self.vocab[a + b])
        self.first = [self.vocab.get(c) for c in byte_chars()]
        self.last = [self.vocab.get(c + self.suffix) for c in byte_chars()]
        self.memo: dict[str, bytes] = {}
        self.memo_size = memo

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    # ------------------------------------------------------------ encoding

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        n, rank, made = len(ids), self.rank, self.made
        if n == 1:
            return ids
        wide = n.bit_length()
        mask = (1 << wide) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank.get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        now.append(-1)
        heap = [r << wide | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            x = pop(heap)
            i = x & mask
            r = x >> wide
            if now[i] != r:
                continue  # stale
            j = after[i]
            ids[i] = new = made[r]
            now[j] = -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank.get(new << 20 | ids[k], -1)
                if r >= 0:
                    push(heap, r << wide | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = rank.get(ids[h] << 20 | new, -1)
                if r >= 0:
                    push(heap, r << wide | h)
        return [x for x, r in zip(ids, now) if r != -2]

    def _word(self, word: str) -> bytes:
        return np.array(self.merge(word), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, memo = self._words.findall(text), self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > self.memo_size:
                memo.clear()
            for w in set(words):
                if w not in memo and len(w) <= MEMO_CHARS:
                    memo[w] = self._word(w)
            return b"".join([memo.get(w) or self._word(w) for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text; special strings in it become special tokens, none is added."""
        if not any(x in text for x in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self._cut.split(text)
        raw = [np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts)]
        return np.frombuffer(b"".join(raw), "<u4")

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings, joined with spaces as the library does without a decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, ids array<int>, decoded).

    A null text counts as empty and has no id. Repeated rows stay. Empty input: empty result. Texts
    of any length are read whole; other columns of docs are ignored.
    """
    return _map(docs, tokenizer, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: (ids.astype(np.int32), text))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s results.

    A null text counts as empty: no token, and the digests of nothing. Repeated rows stay. Empty
    input: empty result. Lone surrogates can't stand in a column of text.
    """
    from hashlib import sha256

    def digest(ids: np.ndarray, text: str) -> tuple[int, str, str]:
        return len(ids), sha256(ids.tobytes()).hexdigest(), sha256(text.encode("utf-8")).hexdigest()

    return _map(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _map(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, fields: str, of) -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for b in batches:
            # a few rows at a time, as results can be several times the text
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [of(ids, codec.decode(ids)) for ids in map(codec.encode, part.column(1).to_pylist())]
                cols = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {fields}")
