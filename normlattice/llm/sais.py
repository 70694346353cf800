"""Suffix arrays by induced sorting, for the shards of suffix_dedup.

Suffixes are classified as L (larger than the next) or S; the leftmost S of each run (LMS) are
sorted by their substrings with two induced scans, named, and, where names repeat, ordered by the
suffix array of the names; two more scans induce all suffixes from them. On a small alphabet a scan
handles a bucket's entries together; on the many symbols of names it handles
stretches of entries that don't induce each other.
"""

from __future__ import annotations

import numpy as np

SMALL = 512


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of s, whose values are in [0, symbols). The end counts as smallest."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    larger = _types(s)
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    induce = _induce_buckets if symbols <= SMALL else _induce_stretches
    sizes = np.bincount(s, minlength=symbols)
    if len(lms) < 2:
        return induce(s, larger, lms, sizes)
    order = induce(s, larger, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(np.append(0, ~_equal_neighbours(s, order, lms)))
    reduced = names[lms]
    count = int(reduced.max()) + 1
    if count < len(lms):
        order = lms[suffix_array(reduced, count)]
    return induce(s, larger, order, sizes)


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than the next; the last is."""
    n = len(s)
    step = np.sign(s[:-1] - s[1:])
    # an equal neighbour has the type of the next position that differs
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    real = nxt < n
    out[:-1][real] = step[nxt[real]] > 0
    return out


def _equal_neighbours(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For each LMS substring but the first in order: is it the same as the one before?"""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms), n - lms[-1]) + 1
    p, q = order[:-1], order[1:]
    same = length[p] == length[q]
    # one that reaches the end has no twin
    same &= (p + length[p] <= n) & (q + length[q] <= n)
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[p[live]] > k]
        differ = s[p[live] + k] != s[q[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    return same


def _ranks(chars: np.ndarray) -> np.ndarray:
    """The rank of each entry among those of its own char, in the given order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    out = np.empty(len(c), np.int64)
    out[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return out


def _induce_buckets(s: np.ndarray, larger: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes induced from LMS suffixes in the given order, a bucket at a time."""
    n, symbols = len(s), len(sizes)
    small = s.astype(np.uint16)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    head, used = starts.copy(), np.flatnonzero(sizes)

    def grow(cur: np.ndarray, place: np.ndarray, want: bool, sign: int) -> None:
        j = cur - 1
        j = j[j >= 0]
        j = j[larger[j] == want]
        if len(j):
            c = small[j]
            sa[place[c] + sign * _ranks(c)] = j
            place += sign * np.bincount(c, minlength=symbols)

    by_char = lms[np.argsort(small[lms], kind="stable")]
    stars = np.searchsorted(small[by_char], np.arange(symbols + 1))
    # the last suffix follows the empty one
    grow(np.array([n]), head, True, 1)
    for c in used.tolist():
        done = starts[c]
        while done < head[c]:
            cur, done = sa[done : head[c]].copy(), head[c]
            grow(cur, head, True, 1)
        if stars[c] < stars[c + 1]:
            grow(by_char[stars[c] : stars[c + 1]], head, True, 1)
    tail = ends - 1
    for c in used[::-1].tolist():
        done = ends[c] - 1
        while done > tail[c]:
            cur, done = sa[tail[c] + 1 : done + 1][::-1].copy(), tail[c]
            grow(cur, tail, False, -1)
        if starts[c] < head[c]:
            grow(sa[starts[c] : head[c]][::-1].copy(), tail, False, -1)
    return sa


def _induce_stretches(s: np.ndarray, larger: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for many symbols: stretches of the array whose entries induce nothing inside the stretch go together."""
    n = len(s)
    ends = np.cumsum(sizes)
    by_char = lms[np.argsort(s[lms], kind="stable")]
    sa = np.full(n, -1, np.int64)
    c = s[by_char]
    count = np.bincount(c, minlength=len(sizes))
    sa[(ends - count)[c] + _ranks(c)] = by_char
    head = ends - sizes
    sa[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    _scan(sa, s, larger, head)
    # from the right, the array read backwards is filled the same way
    back = sa[::-1].copy()
    _scan(back, s, ~larger, n - ends)
    return back[::-1]


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, head: np.ndarray) -> None:
    """Induces the wanted suffixes from the start of sa on; head: the next free place of each symbol."""
    n, i, size = len(sa), 0, 256
    while i < n:
        j = min(n, i + size)
        at = np.flatnonzero(sa[i:j] > 0)
        t = sa[i + at] - 1
        keep = wanted[t]
        at, t = at[keep], t[keep]
        if not len(t):
            i, size = j, min(2 * size, 8192)
            continue
        c = s[t]
        place = head[c] + _ranks(c)
        least = int(place.min())
        if least < j:  # entries before it are settled
            k = int(np.searchsorted(at, least - i))
            t, c, place = t[:k], c[:k], place[:k]
            if least - i < 8:
                sa[place] = t
                head[c] = place + 1
                i, size = _scan_entries(sa, s, wanted, head, least, min(n, least + 256)), 256
                continue
            j, size = least, max(64, least - i)
        else:
            size = min(2 * size, 8192)
        sa[place] = t
        head[c] = place + 1
        i = j


def _scan_entries(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, head: np.ndarray, i: int, j: int) -> int:
    """An entry at a time, where entries induce their neighbours."""
    for k in range(i, j):
        t = int(sa[k]) - 1
        if t >= 0 and wanted[t]:
            c = s[t]
            sa[head[c]] = t
            head[c] += 1
    return j


def permuted_lcp_at_least(text: bytes, sa: np.ndarray, length: int) -> np.ndarray:
    """In text order: does a suffix share its first `length` bytes with its predecessor in sa?

    This is the permuted longest-common-prefix array, compared with length. Suffixes shorter than
    length, or with a shorter predecessor, do not.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, bool)
    live = np.flatnonzero((before >= 0) & (before <= n - length) & (np.arange(n) <= n - length))
    buf = np.frombuffer(text, np.uint8)
    if length >= 8 and n >= 8:
        words = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
        for k in [*range(0, length - 7, 8), length - 8]:
            live = live[words[live + k] == words[before[live] + k]]
    else:
        for k in range(length):
            live = live[buf[live + k] == buf[before[live] + k]]
    out[live] = True
    return out
