"""Suffix arrays by induced sorting, in numpy.

Suffixes are classed S (smaller than the next) or L; leftmost S suffixes' substrings
are sorted by inducing from their first symbols, named, and if names repeat the
string of names is sorted the same way, down to strings of ``LEAST`` names, whose
prefixes are doubled; their order then induces all suffixes.
Scans go through the array in blocks: a block's entries induce at once up to the
first slot that one of them fills, so order is that of a scan entry by entry.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 15
#: Shorter strings of names end the recursion.
LEAST = 1 << 17


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the only smallest one."""
    n = len(t)
    s = np.ones(n, bool)
    less, equal = t[:-1] < t[1:], t[:-1] == t[1:]
    settled = np.where(equal, n, np.arange(n - 1))
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    s[:-1] = less[np.minimum(settled, n - 2)] if n > 1 else True
    return s


def _slots(c: np.ndarray) -> np.ndarray:
    """Rank of each entry among equal ones before it."""
    n = len(c)
    order = np.argsort(c, kind="stable")  # a radix sort for 16-bit symbols
    sorted_ = c[order]
    head = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
    rank = np.empty(n, np.int32)
    at = np.arange(n, dtype=np.int32)
    if len(head):
        begin = np.concatenate([[0], head])
        rank[order] = at - np.repeat(begin, np.diff(np.append(begin, n))).astype(np.int32)
    else:
        rank[order] = at
    return rank


def _induce(t: np.ndarray, s: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array that ``seeds`` (leftmost S suffixes, in order within first symbols) induce."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    c = t[seeds]
    count = np.bincount(c, minlength=len(bounds) - 1)
    order = np.argsort(c, kind="stable")
    sa[bounds[c[order].astype(np.int64) + 1] - count[c[order]] + _slots(c[order])] = seeds[order]
    head = bounds[:-1].copy()
    i, size = 0, 64
    while i < n:
        e = sa[i : i + size]
        at = np.flatnonzero(e > 0)
        p = e[at] - 1
        is_l = ~s[p]
        at, p = at[is_l] + i, p[is_l]
        end = min(i + size, n)
        if len(p):
            c = t[p]
            slot = head[c] + _slots(c)
            low = int(slot.min())
            if low < end:
                end = low
                k = int(np.searchsorted(at, end))
                p, c, slot = p[:k], c[:k], slot[:k]
            sa[slot] = p
            np.maximum.at(head, c, slot + 1)
        size = min(BLOCK, 2 * size) if end == i + size else max(64, 2 * (end - i))
        i = end
    sa[1:][s[sa[1:]] & (sa[1:] >= 0)] = -1
    tail = bounds[1:].copy()
    i, size = n, 64
    while i > 0:
        begin = max(0, i - size)
        e = sa[begin:i][::-1]
        at = np.flatnonzero(e > 0)
        p = e[at] - 1
        is_s = s[p]
        at, p = i - 1 - at[is_s], p[is_s]
        if len(p):
            c = t[p]
            slot = tail[c] - 1 - _slots(c)
            high = int(slot.max())
            if high >= begin:
                begin = high + 1
                k = int(np.count_nonzero(at >= begin))
                p, c, slot = p[:k], c[:k], slot[:k]
            sa[slot] = p
            np.minimum.at(tail, c, slot)
        size = min(BLOCK, 2 * size) if begin == i - size else max(64, 2 * (i - begin))
        i = begin
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, by ranks of prefixes of doubled length."""
    n, k, rank = len(names), 1, names
    while True:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in order.  ``text`` holds small integers of at least 1."""
    n = len(text) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    t = np.zeros(n, np.uint16 if int(text.max()) < 1 << 16 else np.int32)
    t[:-1] = text
    s = _types(t)
    bounds = np.zeros(int(t.max()) + 2, np.int32)
    np.cumsum(np.bincount(t), out=bounds[1:])
    left = np.zeros(n, bool)
    left[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(left)
    sa = _induce(t, s, bounds, lms)
    by = sa[left[np.maximum(sa, 0)] & (sa >= 0)]
    following = np.empty(n, np.int64)
    following[lms] = np.append(lms[1:], n - 1)
    length = following[by] - by + 1
    same = np.zeros(len(by), bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(live):
        live = live[t[by[live] + k] == t[by[live - 1] + k]]
        k += 1
        done = length[live] <= k
        same[live[done]] = True
        live = live[~done]
    name = np.cumsum(~same) - 1
    if int(name[-1]) + 1 < len(by):
        names = np.empty(n, np.int64)
        names[by] = name
        string = names[lms[:-1]]
        by = np.append(n - 1, lms[_doubled(string) if len(string) < LEAST else suffix_array(string)])
    return _induce(t, s, bounds, by)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each entry of the suffix array the symbols it shares with the one before (0 for the first).

    Worked out in text order, permuted: where a suffix and its neighbour are preceded by equal
    symbols, the value is that of the place before less one; only the others, whose values add
    up to n log n at most, are compared, four symbols at a time.  ``text`` holds 1..65535.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    t = np.zeros(n + 8, np.uint16)
    t[:n] = text
    own = (place == 0) | (before <= 0) | (t[place - 1] != t[before - 1])
    four = np.ndarray((n + 5,), "<u8", t, strides=(2,))
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(own & (before >= 0))
    k = 0
    while len(live):
        diff = four[live + k] ^ four[before[live] + k]
        apart = diff != 0
        low = diff[apart]
        shared[live[apart]] = k + sum(((low & np.uint64((1 << 16 * b) - 1)) == 0).astype(np.int64) for b in (1, 2, 3))
        live = live[~apart]
        k += 4
    last = np.maximum.accumulate(np.where(own, place, 0))
    return (shared[last] - (place - last))[sa]
