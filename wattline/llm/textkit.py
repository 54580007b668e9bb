"""Vectorised text primitives on Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  All functions work
on whole texts; a slice of rows is bounded in bytes, and one longer text forms a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wattline.llm.common import worker_cache

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SLICE_BYTES = 128 << 10


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


_LUT = np.zeros(256, bool)
_LUT[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words of consecutive texts: byte ranges ``start:end`` and ``doc`` (offsets of each text's words)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None):
        """``inside``: 256 flags of the bytes that make words, if not all but white space."""
        n = len(data)
        self.data, self.off = data, off
        word = ~_LUT[data] if inside is None else inside[data]
        edge = off[(off > 0) & (off < n)]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def chunk_view(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one little-endian number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunks(view: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges as 8-byte numbers, the last filled with zeros: (numbers, first number of each range, place in its range)."""
    n = (end - start + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * place
    return view[at] & _MASK[np.minimum(np.repeat(end, n) - at, 8)], first, place


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of the byte ranges start:end.

    Each 8 bytes are scrambled on their own, with their place, before they are added up, so
    no algebra of the bytes survives; ranges of one length of up to 8 bytes never collide.
    """
    return span_fingerprints(chunk_view(data) if view is None else view, start, end, (salt,))[0]


def span_fingerprints(view: np.ndarray, start: np.ndarray, end: np.ndarray, salts: tuple[int, ...]) -> list[np.ndarray]:
    """``span_hashes`` for several salts, from bytes that are read once."""
    size = end - start
    head = (view[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * U(0xA0761D6478BD642F)
    out = [mix(head, 2 * salt) for salt in salts]
    long = np.flatnonzero(size > 8)
    if len(long):
        c, first, place = chunks(view, start[long] + 8, end[long])
        where = mix(np.arange(int(place.max()) + 1, dtype=np.uint64), 1)[place]
        for h, salt in zip(out, salts, strict=True):
            h[long] = mix(h[long] + np.add.reduceat(mix(c ^ where, 2 * salt + 1), first), 2 * salt)
    return out


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, kept for the life of the process."""
    held = worker_cache()
    if "powers" not in held or len(held["powers"][0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        out = []
        for b in (BASE, U(pow(int(BASE), -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        held["powers"] = tuple(out)
    return held["powers"]


def rolling(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of k consecutive entries; entry i covers h[i:i+k].  Callers mask what crosses texts.

    Blocks of doubled length are scrambled at every joint; those that k's binary digits name are joined.
    """
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = U((0xD6E8FEB86659FD93 + 2 * salt) | 1)
    block, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            part = block[done : done + m]
            out = part if out is None else mix(out * base + part, salt)
            done += size
        if done == k:
            return mix(out, salt)
        block = mix(block[:-size] * base + block[size:], salt + 1)
        size *= 2


def window_ok(doc: np.ndarray, k: int) -> np.ndarray:
    """True where k consecutive words from i lie in one text (length: words - k + 1)."""
    n = int(doc[-1])
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    last = np.repeat(doc[1:], np.diff(doc))
    return np.arange(m) + k <= last[:m]


class Triples:
    """Triples of 64-bit numbers (a block: left symbol, right symbol or 0, run lengths, the right one in the upper half)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, l: np.ndarray):
        self.a, self.b, self.l = a, b, l
        self.key = mix(a + b * U(0xD6E8FEB86659FD93) + l * U(0xA0761D6478BD642F), 41)

    def __len__(self):
        return len(self.key)

    def take(self, at: np.ndarray) -> Triples:
        out = object.__new__(Triples)
        out.a, out.b, out.l, out.key = self.a[at], self.b[at], self.l[at], self.key[at]
        return out

    @staticmethod
    def joined(parts: list[Triples]) -> Triples:
        cat = lambda x: np.concatenate([*x, np.zeros(0, U)])
        return Triples(cat([p.a for p in parts]), cat([p.b for p in parts]), cat([p.l for p in parts]))

    def distinct(self) -> tuple[Triples, np.ndarray, np.ndarray]:
        """(distinct triples by key, the index among them of each of these, the place of the first of each)."""
        n = len(self.key)
        order = np.argsort(self.key)
        key = self.key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        again = np.flatnonzero(~new)
        x, y = order[again], order[again - 1]
        if ((self.a[x] != self.a[y]) | (self.b[x] != self.b[y]) | (self.l[x] != self.l[y])).any():  # two triples of one key: order them by all they are
            order = np.lexsort((self.l, self.b, self.a, self.key))
            x, y = order[1:], order[:-1]
            new[1:] = (self.key[x] != self.key[y]) | (self.a[x] != self.a[y]) | (self.b[x] != self.b[y]) | (self.l[x] != self.l[y])
        index = np.empty(n, np.int64)
        index[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if n else order
        return self.take(first), index, first
