"""Token counts with a public tokenizer, in bounded memory whatever the length of a text.

A text is encoded in overlapping chunks with offsets. An overlap reaches from the end of a chunk back
to a stable place and a margin before it. Two chunks are spliced at a stable place inside their
overlap, where both have a token boundary and agree on the tokens that follow. Where they don't, the
overlap is widened, and in the end the chunk.

A place is stable if the byte-level pattern can't match across it, whatever stands around: between
a character that is no white space and one that is, and between letters, numbers and other
characters, but not from a white space to what follows nor from an apostrophe to a letter, which
can be one match. Characters that were of another class, or none, in an old version of Unicode are
taken for none of the three, as the library may have any version. So the tokens on the two sides of a stable place don't depend on each other.

A tokenizer with another pattern encodes each text in one call.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and the least of its overlap with the next one where that has been widened.
CHUNK, OVERLAP = 1024, 96
#: Characters at the ends of an overlap whose tokens may lack what stands around; no added token is as long.
MARGIN = 24
LIMIT = 1024

#: Unicode's White_Space, as the library's pattern has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Classes of the characters before and after a stable place, but for a letter after an apostrophe.
_CHANGES = {(a, SPACE) for a in (LETTER, NUMBER, OTHER, UNSURE)} | {(a, b) for a in (LETTER, NUMBER, OTHER) for b in (LETTER, NUMBER, OTHER) if a != b}


@cache
def classes() -> bytes:
    """The class of each character of the basic plane; UNSURE where that of Unicode 3.2 is another one than now."""
    old, white = unicodedata.ucd_3_2_0.category, re.compile(f"[{WHITE}]")
    out = bytearray([UNSURE]) * 0x10000
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if white.match(chr(c)):
            out[c] = SPACE
        elif kind == old(chr(c)) and kind not in ("Cn", "Cs", "Co"):
            out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    return bytes(out)


def stable_places(text: str, first: int, end: int) -> Iterator[int]:
    """Stable places from first up to before end, the last one first."""
    kinds = classes()
    after = UNSURE
    for p in range(end - 1, max(first, 1) - 2, -1):
        c = ord(text[p])
        kind = kinds[c] if c < 0x10000 else UNSURE
        if p < end - 1 and (kind, after) in _CHANGES and not (after == LETTER and text[p] == "'"):
            yield p + 1
        after = kind


class Counter:
    """Counts the tokens of texts; one for each worker process and tokenizer."""

    _own: dict[str, Counter] = {}

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        odd = [a for a in added if a["lstrip"] or a["rstrip"] or a["single_word"] or len(a["content"]) >= MARGIN]
        self.splits = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not odd

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        if not self.splits:
            return len(self._encode(text))
        return sum(n for n, _ in self.spliced(text))

    def ids(self, text: str) -> list[int]:
        return [x for _, part in self.spliced(text) for x in part()]

    def spliced(self, text: str):
        """(number, function that gives the ids) of a text's tokens in parts, from overlapping chunks.

        At most two chunks are held. A chunk is widened by doubling, so the work stays in proportion
        to the text where no place is stable.
        """
        at, end, skip, done = 0, min(len(text), self.chunk), 0, 0
        left, ids = self._encode(text[at:end]), None
        while end < len(text):
            places, wide, cut = self._places(text, at, end, done), 0, None
            while cut is None:
                # the overlap reaches back to a stable place, so that most align at once
                p = next((p for p in places if end - p + MARGIN >= wide), None)
                if p is None:  # no overlap within the chunk aligns: a chunk twice as wide
                    end = min(len(text), at + 2 * (end - at))
                    left, ids = self._encode(text[at:end]), None
                    if end == len(text):
                        break
                    places, wide = self._places(text, at, end, done), 0
                    continue
                begin = p - MARGIN
                wide = max(self.overlap, 2 * (end - begin))
                until = min(len(text), begin + max(self.chunk, wide))
                right = self._encode(text[begin:until])
                # an encoding makes a new list of its ids each time that it is asked
                ids, new = left.ids if ids is None else ids, right.ids
                cut = self._splice(text, left, ids, at, end, right, new, begin, done)
            if cut is None:
                break
            i, j, done = cut
            yield i - skip, lambda ids=ids, skip=skip, i=i: ids[skip:i]
            left, ids, at, end, skip = right, new, begin, until, j
        yield len(left) - skip, lambda left=left, skip=skip: left.ids[skip:]

    @staticmethod
    def _places(text: str, at: int, end: int, done: int) -> Iterator[int]:
        """Stable places of the chunk from at to end where it can be cut, the last one first."""
        return stable_places(text, max(at + MARGIN, done) + 1, end - MARGIN)

    def _splice(self, text, left, left_ids, at, end, right, right_ids, begin, done) -> tuple[int, int, int] | None:
        """Tokens of left before, and of right before, a stable boundary of both after done whose followers agree; its place."""
        sure = end - MARGIN
        for p in stable_places(text, max(begin + MARGIN, done + 1), sure):
            i, j = left.char_to_token(p - at), right.char_to_token(p - begin)
            if i is None or j is None or left.token_to_chars(i)[0] != p - at or right.token_to_chars(j)[0] != p - begin:
                continue
            # a character of several tokens: the first of them
            while i and left.token_to_chars(i - 1)[0] == p - at:
                i -= 1
            while j and right.token_to_chars(j - 1)[0] == p - begin:
                j -= 1
            k = left.char_to_token(sure - at)
            n = (k - i) if k is not None else 1
            if left_ids[i : i + n] == right_ids[j : j + n]:
                return i, j, p
        return None


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit).

    tokenizer: the path of a .json file of the tokenizers library, on every executor. A null text
    counts as empty and has no token. Repeated rows stay. Empty input: empty result. Texts of any
    length take the same way; other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for b in batches:
            n = pa.array([counter.count(x.as_py()) for x in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
