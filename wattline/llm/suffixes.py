"""Substring dedup on suffix-array shards.

Texts are bytes; a byte goes if a ``WINDOW``-byte string that covers it also
starts earlier.  Each window is filed under the smallest fingerprint of the
``GRAM``-byte strings in it; windows in a row under the same one form a piece.
Groups of documents first exchange fingerprints of pieces: of equal ones the
earliest counts, the others go.  Where different pieces share a fingerprint their
earliest holders send them to its shard, so equal windows meet in one shard.  It
builds the suffix array of its pieces by induced sorting and the common prefixes of
neighbours in permuted (text) order; suffixes between which no prefix falls below
``WINDOW`` bytes begin equal windows, and the earliest of them stays.

Fingerprints with more than ``HOT`` pieces in all are dealt window by window, by
the window's own fingerprint, so no shard has to hold them alone.

Defined cases: null and empty texts have no bytes; windows never cross documents;
rows with equal ids count as one document's parts in order of text; null ids come
last; repeated rows, extra columns and empty tables are fine.  Whole pieces are
told apart by two 64-bit fingerprints of their bytes, windows in shards by their bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wattline.llm.common import Scratch, bound_batches, table
from wattline.llm.exchange import Group, answer, by_range, flags_of, rounds, rows_to, stretches
from wattline.llm.induced import common_prefixes, suffix_array
from wattline.llm.textkit import Triples, chunk_view, mix, powers, slices

WINDOW = 100
GRAM = 32
HOT = 4096
#: Bytes of text for each entry of a reducer's quarter of a million: few enough that its suffix arrays take seconds.
BYTES_PER_ENTRY = 9
#: Bytes of a suffix array; one fingerprint's pieces stay together.
SHARD_BYTES = 2 << 20
U = np.uint64


#: Fingerprints are compared by their upper 40 bits; the lower ones make room for places.
PLACE = U((1 << 24) - 1)


class Prints:
    """Fingerprints of any byte ranges of at least 8 bytes, from sums over their 8-byte strings.

    Each 8-byte string is scrambled before it is weighted by its place, so no algebra of
    the bytes survives.
    """

    def __init__(self, data: np.ndarray):
        n = max(0, len(data) - 7)
        self.power, self.inverse = powers(n)
        self.eight = mix(chunk_view(data)[:n], 2)
        self.one, self.two = self._sums(self.eight), None

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.empty(len(x) + 1, U)
        total[0] = 0
        np.cumsum(x * self.power[: len(x)], out=total[1:])
        return total

    def all(self, size: int, salt: int) -> np.ndarray:
        """One fingerprint of each range of ``size`` bytes."""
        m = size - 7
        return mix((self.one[m:] - self.one[:-m]) * self.inverse[: len(self.one) - m], salt)

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent fingerprints of each range start:end."""
        if self.two is None:
            self.two = self._sums(mix(self.eight, 9))
        size, back = (end - start).astype(U), self.inverse[start]
        return tuple(mix((total[end - 7] - total[start]) * back + size * U(0xA0761D6478BD642F), salt + k) for k, total in enumerate((self.one, self.two)))


def lowest(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the first smallest of h[i:i+w], by upper bits (length: len(h) - w + 1)."""
    n = len(h)
    m = n - w + 1
    if n > int(PLACE):
        return _lowest_far(h >> U(24), w)
    rows = -(-n // w)
    x = np.full(rows * w, np.iinfo(np.uint64).max, U)
    np.bitwise_or(h & ~PLACE, np.arange(n, dtype=U), out=x[:n])
    x = x.reshape(rows, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(suf[:m], pre[w - 1 : n]) & PLACE).astype(np.int64)


def _lowest_far(h: np.ndarray, w: int) -> np.ndarray:
    """The same in parts that places fit into."""
    step = int(PLACE) - w
    parts = [lowest(h[i : i + step + w - 1] << U(24), w) + i for i in range(0, len(h) - w + 1, step)]
    return np.concatenate(parts)


class Pieces:
    """A group's pieces in order: start (byte in the group), windows, fingerprint (key) and content (two fingerprints and the key)."""

    def __init__(self, group: Group):
        self.group = group
        start, wins, key, one, two = [], [], [], [], []
        for i, j in slices(group.off):
            base = int(group.off[i])
            data, off = group.data[base : group.off[j]], group.off[i : j + 1] - base
            n = len(data)
            if n < WINDOW:
                continue
            prints = Prints(data)
            h = prints.all(GRAM, 3)
            at = lowest(h, WINDOW - GRAM + 1)
            ok = np.zeros(len(at) + 1, np.int32)
            full = np.flatnonzero(np.diff(off) >= WINDOW)
            ok[off[full]] += 1
            ok[off[full + 1] - WINDOW + 1] -= 1
            ok = np.cumsum(ok)[:-1] > 0
            head = ok.copy()
            head[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
            head[off[full]] = True
            s = np.flatnonzero(head)
            runs = np.add.reduceat(ok, s) if len(s) else np.zeros(0, np.int64)
            start.append(s + base)
            wins.append(runs.astype(np.int64))
            key.append(mix(h[at[s]], 7))  # smallest fingerprints are small: spread them again
            for out, found in zip((one, two), prints.spans(s, s + runs + WINDOW - 1, 4), strict=True):
                out.append(found)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.wins, self.key = cat(start, np.int64), cat(wins, np.int64), cat(key, U)
        self.content = Triples(cat(one, U), cat(two, U), self.key)
        _, _, first = self.content.distinct()
        #: Whether a piece is the first of its content; those pieces, by fingerprint and content.
        self.is_first = np.zeros(len(self.start), bool)
        self.is_first[first] = True
        self.first = first[np.lexsort((self.content.b[first], self.content.a[first], self.key[first]))]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.group.off, at, "right") - 1


class Sent:
    """What a group sends in the second exchange: pieces that it holds first, where others share their fingerprint; single windows of hot ones."""

    def __init__(self, p: Pieces, answers: pa.Table, reducers: int):
        bits = flags_of(answers, 1, by_range(p.key[p.first], reducers), np.full(len(p.first), 3)).reshape(-1, 3)
        #: Pieces whose content a smaller document of another group holds.
        self.late = p.first[bits[:, 0]]
        plain = p.first[~bits[:, 0] & bits[:, 1] & ~bits[:, 2]]
        of_hot = np.sort(p.first[~bits[:, 0] & bits[:, 1] & bits[:, 2]])
        at, n, key = p.start[plain], p.wins[plain], p.key[plain]
        self.hot_at = np.repeat(p.start[of_hot], p.wins[of_hot]) + _ramp(p.wins[of_hot])
        if len(self.hot_at):
            one, two = np.empty(len(self.hot_at), U), np.empty(len(self.hot_at), U)
            group = p.group
            for i, j in slices(group.off):
                a, b = int(group.off[i]), int(group.off[j])
                lo, hi = np.searchsorted(self.hot_at, a), np.searchsorted(self.hot_at, b)
                if lo < hi:
                    data, x = group.data[a:b], self.hot_at[lo:hi] - a
                    one[lo:hi], two[lo:hi] = Prints(data).spans(x, x + WINDOW, 6)
            windows, self.hot_kind, first = Triples(one, two, np.zeros(len(one), U)).distinct()
            names = windows.key
            self.hot_first = first
            at, n, key = np.concatenate([at, self.hot_at[first]]), np.concatenate([n, np.ones(len(names), np.int64)]), np.concatenate([key, names])
        self.n_plain = len(plain)
        self.order = np.argsort(key, kind="stable")
        self.at, self.n, self.key = at[self.order], n[self.order], key[self.order]
        self.reducer = by_range(self.key, reducers)


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


HEAD = "<Q"


def _first(reducers: int):
    def work(group, _):
        p = Pieces(group)
        key, one, two = p.key[p.first], p.content.a[p.first], p.content.b[p.first]
        doc = p.group.id[p.row_of(p.start[p.first])]
        small = len(doc) == 0 or (int(doc.min()) >= 0 and int(doc.max()) < 1 << 32)
        doc = doc.astype(np.uint32 if small else np.int64)
        parted = stretches(by_range(key, reducers))
        body = [struct.pack(HEAD, doc.itemsize) + b"".join(x[a:b].tobytes() for x in (key, one, two, doc)) for _, a, b in parted]
        return rows_to(p.group.g, [k for k, _, _ in parted], body)

    return work


def _reduce_first(senders, bodies, r):
    """Three bits: a smaller document elsewhere holds the piece; other pieces share its fingerprint; so many that it is hot."""
    key, one, two, doc, counts = [], [], [], [], []
    for body in bodies:
        (width,) = struct.unpack_from(HEAD, body)
        n = (len(body) - 8) // (24 + width)
        counts.append(n)
        for k, out in enumerate((key, one, two)):
            out.append(np.frombuffer(body, U, n, 8 + 8 * n * k))
        doc.append(np.frombuffer(body, np.uint32 if width == 4 else np.int64, n, 8 + 24 * n).astype(np.int64))
    key, one, two, doc = (np.concatenate(x) for x in (key, one, two, doc))
    _, which, at = Triples(one, two, key).distinct()
    low = np.full(len(at), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(low, which, doc)
    _, owner, kinds = np.unique(key[at], return_inverse=True, return_counts=True)
    several = kinds[owner][which]
    return answer(senders, r, 1, np.stack([low[which] < doc, several > 1, several > HOT], axis=1).ravel(), 3 * np.array(counts))


def _second(reducers: int):
    def work(group, answers):
        p = Pieces(group)
        s = Sent(p, answers, reducers)
        size = s.n + WINDOW - 1
        parted, body = stretches(s.reducer), []
        doc = group.id[p.row_of(s.at)]
        whole, end = group.data.tobytes(), s.at + size
        for _, a, b in parted:
            text = [whole[x:y] for x, y in zip(s.at[a:b].tolist(), end[a:b].tolist(), strict=True)]
            body.append(b"".join([struct.pack(HEAD, b - a), s.key[a:b].tobytes(), doc[a:b].tobytes(), s.at[a:b].tobytes(), s.n[a:b].astype(np.uint32).tobytes(), *text]))
        return rows_to(group.g, [k for k, _, _ in parted], body)

    return work


def shard(texts: list[bytes], wins: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window of distinct pieces whether an equal one comes earlier; windows of a piece follow each other in ``order``."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    base = np.cumsum(size + 1) - size - 1
    symbols = data.astype(np.int32) + 2
    symbols[base + size] = 1
    valid = np.full(len(data), -1, np.int64)
    at = np.repeat(base, wins) + _ramp(wins)
    valid[at] = np.arange(len(at))
    sa = suffix_array(symbols)
    kind = np.cumsum(common_prefixes(symbols, sa) < WINDOW)
    keep = valid[sa] >= 0
    sa, kind = sa[keep], kind[keep]
    begins = np.ones(len(sa), bool)
    begins[1:] = kind[1:] != kind[:-1]
    when = (np.repeat(order, wins) + _ramp(wins))[valid[sa]]
    out = np.zeros(len(at), bool)
    if len(sa):
        first = np.minimum.reduceat(when, np.flatnonzero(begins))
        out[valid[sa]] = first[np.cumsum(begins) - 1] < when
    return out


def _reduce_second(senders, bodies, r):
    """A bit a window: an equal one comes earlier."""
    key, doc, pos, wins, texts, per = [], [], [], [], [], []
    for body in bodies:
        (n,) = struct.unpack_from(HEAD, body)
        at = 8
        for out, kind in ((key, U), (doc, np.int64), (pos, np.int64), (wins, np.uint32)):
            out.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        ends = at + np.cumsum(wins[-1].astype(np.int64) + WINDOW - 1)
        texts += [body[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        per.append(int(wins[-1].sum()))
    key, doc, pos, wins = np.concatenate(key), np.concatenate(doc), np.concatenate(pos), np.concatenate(wins).astype(np.int64)
    _, rank = np.unique(doc, return_inverse=True)
    order = (rank.astype(np.int64) << 36) + pos
    ids: dict[bytes, int] = {}
    kind = np.fromiter((ids.setdefault(t, len(ids)) for t in texts), np.int64, len(texts))
    low = np.full(len(ids), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(low, kind, order)
    sample = np.zeros(len(ids), np.int64)
    sample[kind] = np.arange(len(kind))
    own_key, own_wins = key[sample], wins[sample]
    begin = np.cumsum(own_wins) - own_wins
    dup = np.zeros(int(own_wins.sum()), bool)
    by = np.argsort(own_key, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = own_key[by[1:]] != own_key[by[:-1]]
    first = np.flatnonzero(head)
    several = np.diff(np.append(first, len(by))) > 1
    distinct = list(ids)
    batch: list[int] = []
    held = 0

    def run():
        nonlocal batch, held
        b = np.array(batch)
        dup[np.repeat(begin[b], own_wins[b]) + _ramp(own_wins[b])] = shard([distinct[i] for i in batch], own_wins[b], low[b])
        batch, held = [], 0

    for a, n in zip(first[several].tolist(), np.diff(np.append(first, len(by)))[several].tolist(), strict=True):
        some = by[a : a + n].tolist()
        more = sum(len(distinct[i]) + 1 for i in some)
        if batch and held + more > SHARD_BYTES:
            run()
        batch += some
        held += more
    if batch:
        run()
    flags = dup[np.repeat(begin[kind], wins) + _ramp(wins)] | np.repeat(order > low[kind], wins)
    return answer(senders, r, 2, flags, np.array(per))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(group: Group, answers: pa.Table, reducers: int) -> np.ndarray:
    """Flag of each byte of the group that goes."""
    p = Pieces(group)
    s = Sent(p, answers, reducers)
    bits = flags_of(answers, 2, s.reducer, s.n)
    again = np.concatenate([np.flatnonzero(~p.is_first), s.late])
    where = (np.repeat(s.at, s.n) + _ramp(s.n))[bits]
    if len(s.hot_at):
        place = np.empty(len(s.order), np.int64)
        place[s.order] = (np.cumsum(s.n) - s.n)
        late = bits[place[s.n_plain :]][s.hot_kind]
        late |= np.arange(len(s.hot_at)) != s.hot_first[s.hot_kind]
        where = np.concatenate([where, s.hot_at[late]])
    n = len(group.data) + 1
    begins = np.bincount(np.concatenate([p.start[again], where]), minlength=n)
    ends = np.bincount(np.concatenate([p.start[again] + p.wins[again] + WINDOW - 1, where + WINDOW]), minlength=n)
    return np.cumsum(begins - ends)[:-1] > 0


def _last(reducers: int, spans: bool = False):
    def work(group, answers):
        gone = _removed(group, answers, reducers)
        n_removed, n_spans, digest, found = [], [], [], []
        for a, b in zip(group.off[:-1].tolist(), group.off[1:].tolist(), strict=True):
            off = gone[a:b]
            n = int(np.count_nonzero(off))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))) if n else np.zeros(0, np.int64)
            n_removed.append(n)
            n_spans.append(len(edge) // 2)
            digest.append(hashlib.sha256(group.data[a:b][~off].tobytes() if n else group.data[a:b].tobytes()).hexdigest())
            found.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()] if spans else None)
        cols = [pa.array(group.id, mask=group.null_id), pa.array(np.diff(group.off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if spans:
            cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names.append("spans")
        return pa.Table.from_arrays(cols, names=names)

    return work


def repeats_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the removed byte ranges) of every row."""
    bound_batches(docs.sparkSession)
    schema = RESULT + (", spans array<struct<start:long,end:long>>" if spans else "")
    return rounds(docs, Scratch(docs.sparkSession, "suffixes"), id_col, text_col, [(_first, _reduce_first), (_second, _reduce_second)], lambda n: _last(n, spans), schema, BYTES_PER_ENTRY)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
