"""Substring dedup by recompression.

A text's words are the first symbols.  Each round names blocks of symbols, globally
and in Spark: runs of equal symbols, and pairs of neighbouring runs of which the
left one is on the left and the right one on the right side of a partition of the
symbols.  Groups of documents send their distinct blocks (parts and run lengths) to
reducers, which compare them in full and hand out one number a block; the numbers
are the next round's symbols.  So two symbols of one number stand for equal words,
however long, and equal substrings get equal symbols in their interior.  For each
symbol the range of words that settled it (its context) is carried along: a window
that holds the context holds the symbol, wherever it stands.

Every ``WINDOW``-word window picks the best symbol whose context it holds (highest
round first, then smallest key); equal windows pick equal symbols.  The keys of the
symbols are exchanged; windows whose symbol another group shares are exchanged in
full (two 64-bit fingerprints of the 13 words, from independent fingerprints of
their words), which confirms the repeat and finds its smallest document.

Words are told apart by 63-bit fingerprints of their bytes as first symbols and by
64 + 64 bits in windows; numbers of blocks are exact.

Defined cases: null and empty texts have no words; windows never cross
documents; rows with equal ids never remove words of each other; null ids come
after all others; repeated rows, extra columns and empty tables are fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wattline.llm.common import Scratch, bound_batches, table
from wattline.llm.exchange import Group, answer, by_range, flags_of, numbers_of, rounds, send
from wattline.llm.textkit import Triples, Words, chunk_view, mix, powers, rolling, slices, span_fingerprints, window_ok

WINDOW = 13
#: Words of text around a symbol that its key covers at least.
SPAN = 7
#: Rounds whose symbols have contexts that a window can hold: a fourth round's context fits in 3 windows of 100,000.
ROUNDS = 3
U = np.uint64
#: Words have this bit, numbers of blocks don't.
WORD = U(1 << 63)


class Symbols:
    """Symbols of one round: name, words start:end, context from:to; contexts past a text's ends are unusable.

    ``begin`` holds the first symbol of each text that has one.
    """

    def __init__(self, name, start, end, lo, hi, begin):
        self.name, self.start, self.end, self.lo, self.hi, self.begin = name, start, end, lo, hi, begin

    def __len__(self):
        return len(self.name)

    def neighbours(self, far: int) -> tuple[np.ndarray, np.ndarray]:
        """Context start of each left neighbour and context end of each right one; unusable at a text's edge."""
        left, right = np.empty_like(self.lo), np.empty_like(self.hi)
        left[1:], right[:-1] = self.lo[:-1], self.hi[1:]
        left[self.begin] = -far
        right[self.begin[1:] - 1] = right[-1] = far
        return left, right


def pair_up(s: Symbols, salt: int, far: int) -> tuple[Symbols, Triples, np.ndarray, np.ndarray]:
    """Runs and pairs of runs of a round's symbols.

    (symbols of the next round, named like their left part; blocks that need a name; their places; places of pairs)
    """
    none = np.zeros(0, np.int64)
    if not len(s):
        return s, Triples(s.name, s.name, s.name), none, none
    left, right = s.neighbours(far)
    same = s.name[1:] == s.name[:-1]
    same[s.begin[1:] - 1] = False
    if same.any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(first[1:], len(s)) - 1
        length = (last - first + 1).astype(U)
        run = Symbols(s.name[first], s.start[first], s.end[last], left[first], right[last], np.searchsorted(first, s.begin))
    else:
        length = np.ones(len(s), U)
        run = Symbols(s.name, s.start, s.end, left, right, s.begin)
    n = len(run)
    right_side = ((run.name + length * U(0xA24BAED4963EE407) + U(salt)) * U(0x9FB21C651E98DF25)).view(np.int64) < 0
    opens = np.zeros(n, bool)
    opens[:-1] = right_side[1:] & ~right_side[:-1]
    opens[run.begin[1:] - 1] = False
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    left, right = run.neighbours(far)
    alone = ~(opens | closes)
    hi = np.where(alone & ~right_side, np.maximum(run.hi, right), run.hi)
    lo = np.where(alone & right_side, np.minimum(run.lo, left), run.lo)
    at = np.flatnonzero(opens)
    end = run.end.copy()
    end[at] = run.end[at + 1]
    lo[at], hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
    kept = np.flatnonzero(~closes)
    place = np.cumsum(~closes) - 1
    named = np.flatnonzero((opens | (length > U(1))) & ~closes)
    pair, after = opens[named], np.minimum(named + 1, n - 1)
    other = np.where(pair, run.name[after], U(0))
    lengths = length[named] | np.where(pair, length[after], U(0)) << U(32)
    out = Symbols(run.name[kept], run.start[kept], end[kept], lo[kept], hi[kept], place[run.begin])
    return out, Triples(run.name[named], other, lengths), place[named], place[at]


class Slice:
    """Consecutive texts on their way through the rounds."""

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.h, self.doc = h, doc
        n = len(h)
        self.far = n + WINDOW + 1
        at = np.arange(n, dtype=np.int32 if n < 1 << 30 else np.int64)
        size = np.diff(doc)
        self.text_end = np.repeat(doc[1:], size).astype(at.dtype)
        self.s = Symbols(h | WORD, at, at + 1, at, at + 1, doc[:-1][size > 0])
        self.found: list[tuple] = []
        self.round = 0

    def blocks(self) -> Triples:
        """Enter the next round: the blocks that need a name."""
        self.round += 1
        self.s, found, self.named, self.pairs = pair_up(self.s, 100 * self.round, self.far)
        return found

    def take(self, names: np.ndarray) -> None:
        """End the round with its names."""
        self.s.name[self.named] = names
        s, at, n = self.s, self.pairs, len(self.h)
        lo = s.lo[at]
        hi = np.maximum(s.hi[at], lo + SPAN)
        fits = np.flatnonzero((lo >= 0) & (hi - lo <= WINDOW) & (hi <= n))
        fits = fits[hi[fits] <= self.text_end[lo[fits]]]
        at, lo, hi = at[fits], lo[fits], hi[fits]
        self.found.append((self.round, lo, hi, s.name[at], s.start[at] - lo))

    def anchors(self) -> np.ndarray:
        """For each window start the key of the symbol it picks; 0 where no window starts.  A function of the window's words."""
        h, doc, n = self.h, self.doc, len(self.h)
        key = np.zeros(n, U)
        open_ = np.flatnonzero(window_ok(doc, WINDOW))
        power, inverse = powers(n)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum(h * power[:n], out=total[1:])
        lo = np.flatnonzero(window_ok(doc, SPAN))
        words = (0, lo, lo + SPAN, h[lo], np.zeros(len(lo), np.int64))
        for r, lo, hi, name, offset in [*reversed(self.found), words]:
            if not len(open_) or not len(lo):
                continue
            k = mix((total[hi] - total[lo]) * inverse[lo] + name * U(0xD6E8FEB86659FD93) + (offset.astype(U) << U(8) | U(r)), 31)
            begins = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=n + WINDOW + 1))])
            ends = np.concatenate([[0], np.cumsum(np.bincount(hi, minlength=n + WINDOW + 1))])
            i, j = begins[open_], ends[open_ + WINDOW + 1]
            some = i < j
            i, j, at = i[some], j[some], open_[some]
            best = k[i]
            step = 1
            live = np.flatnonzero(i + step < j)
            while len(live):
                best[live] = np.minimum(best[live], k[i[live] + step])
                step += 1
                live = live[i[live] + step < j[live]]
            key[at] = mix(best, 33) | U(1)
            open_ = open_[~some]
        return key


def _windows(h: np.ndarray, salt: int) -> np.ndarray:
    out = np.zeros(len(h), U)
    got = rolling(h, WINDOW, salt)
    out[: len(got)] = got
    return out


class Parsed:
    """A group after ``upto`` rounds.

    ``blocks`` are the last round's distinct blocks where names for them are still to come;
    otherwise ``key`` and, with ``hashes``, ``win`` hold each window's symbol key and fingerprints.
    """

    def __init__(self, group: Group, answers: pa.Table, reducers: int, upto: int = ROUNDS, hashes: bool = False):
        parts, wins, counts = [], [], []
        for i, j in slices(group.off):
            words = Words(group.data[group.off[i] : group.off[j]], group.off[i : j + 1] - group.off[i])
            view = chunk_view(words.data)
            h, *other = span_fingerprints(view, words.start, words.end, (0, 1) if hashes else (0,))
            parts.append(Slice(h, words.doc))
            counts.append(np.diff(words.doc))
            if hashes:
                wins.append((_windows(h, 5), _windows(other[0], 6)))
        for r in range(1, upto + 1):
            found = [p.blocks() for p in parts]
            if r < ROUNDS:
                self.blocks, index, _ = Triples.joined(found).distinct()
                if r == upto:
                    return
                names = numbers_of(answers, r, by_range(self.blocks.key, reducers))[index]
            else:
                names = np.concatenate([*(b.key for b in found), np.zeros(0, U)]) & ~WORD
            at = 0
            for p, b in zip(parts, found, strict=True):
                p.take(names[at : at + len(b)])
                at += len(b)
        self.key = np.concatenate([*(p.anchors() for p in parts), np.zeros(0, U)])
        self.win = tuple(np.concatenate([*x, np.zeros(0, U)]) for x in zip(*wins, strict=True)) or (np.zeros(0, U),) * 2
        self.n_words = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.at = np.flatnonzero(self.key)
        #: Windows in a row under one symbol: their key's index among ``symbols``, and how many they are.
        key = self.key[self.at]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (np.diff(self.at) > 1)
        first = np.flatnonzero(head)
        self.run = np.diff(np.append(first, len(key)))
        key = key[first]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.symbols = key[new]
        self.kind = np.empty(len(key), np.int64)
        self.kind[order] = np.cumsum(new) - 1

    def windows(self, picked: np.ndarray, group: Group) -> tuple[np.ndarray, Triples, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose symbol is ``picked``: (their positions, distinct ones, smallest document of each, index of each, first of each)."""
        at = self.at[np.repeat(picked[self.kind], self.run)]
        names, index, first = Triples(self.win[0][at], self.win[1][at], np.zeros(len(at), U)).distinct()
        low = np.full(len(names), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(low, index, group.id[self.row[at]])
        return at, names, low, index, first


def _send_blocks(r: int):
    def make(reducers: int):
        def work(group, answers):
            b = Parsed(group, answers, reducers, r).blocks
            return send(group.g, by_range(b.key, reducers), [b.a, b.b, b.l])

        return work

    return make


def _columns(bodies: list[bytes], kinds: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of 8-byte numbers from all senders, entries of each sender)."""
    counts = np.array([len(b) // (8 * len(kinds)) for b in bodies])
    each = [[np.frombuffer(b, kind, n, 8 * n * k) for b, n in zip(bodies, counts.tolist(), strict=True)] for k, kind in enumerate(kinds)]
    return [np.concatenate(x) for x in each], counts


def _name_blocks(step: int):
    def work(senders, bodies, r):
        """One number a distinct block: round, reducer, rank."""
        (a, b, l), counts = _columns(bodies, (U, U, U))
        _, index, _ = Triples(a, b, l).distinct()
        return answer(senders, r, step, (index.astype(U) + U(1)) | U(step << 58 | r << 34), counts)

    return work


def _send_symbols(reducers: int):
    def work(group, answers):
        keys = Parsed(group, answers, reducers).symbols
        return send(group.g, by_range(keys, reducers), [keys])

    return work


def _share_symbols(senders, bodies, r):
    """Bit: another group sent the symbol too."""
    (keys,), counts = _columns(bodies, (U,))
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return answer(senders, r, ROUNDS, n[inverse] > 1, counts)


def _shared(p: Parsed, answers: pa.Table, reducers: int) -> np.ndarray:
    """Whether other groups hold each symbol too."""
    return flags_of(answers, ROUNDS, by_range(p.symbols, reducers))


def _send_windows(reducers: int):
    def work(group, answers):
        p = Parsed(group, answers, reducers, hashes=True)
        _, names, low, _, _ = p.windows(_shared(p, answers, reducers), group)
        return send(group.g, by_range(names.key, reducers), [names.a, names.b, low])

    return work


def _first_windows(senders, bodies, r):
    """Bit: another group holds the window in a smaller document than any of the sender's."""
    (a, b, ids), counts = _columns(bodies, (U, U, np.int64))
    names, index, _ = Triples(a, b, np.zeros(len(a), U)).distinct()
    low = np.full(len(names), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(low, index, ids)
    return answer(senders, r, ROUNDS + 1, low[index] < ids, counts)


STEPS = [*((_send_blocks(r), _name_blocks(r)) for r in range(1, ROUNDS)), (_send_symbols, _share_symbols), (_send_windows, _first_windows)]
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(group: Group, answers: pa.Table, reducers: int) -> tuple[Parsed, np.ndarray]:
    """(windows, flag of each word that goes)."""
    p = Parsed(group, answers, reducers, hashes=True)
    shared = _shared(p, answers, reducers)
    several = np.bincount(p.kind, minlength=len(p.symbols)) > 1
    at, names, low, index, first = p.windows(shared | several, group)
    # Distinct windows come in the order in which the shared ones among them were sent.
    of_shared = np.zeros(len(p.key), bool)
    of_shared[p.at] = np.repeat(shared[p.kind], p.run)
    sent = of_shared[at[first]]
    earlier = np.zeros(len(names), bool)
    earlier[sent] = flags_of(answers, ROUNDS + 1, by_range(names.key[sent], reducers))
    gone = np.zeros(len(p.key), bool)
    gone[at] = earlier[index] | (low[index] < group.id[p.row[at]])
    mark = np.zeros(len(gone) + WINDOW + 1, np.int32)
    at = np.flatnonzero(gone)
    mark[at] += 1
    mark[at + WINDOW] -= 1
    return p, np.cumsum(mark)[: len(gone)] > 0


def _last(reducers: int, texts: bool = False):
    def work(group, answers):
        p, removed = _removed(group, answers, reducers)
        whole = group.data.tobytes()
        n_removed, digest, kept_text, i = [], [], [], 0
        for a, b, n in zip(group.off[:-1].tolist(), group.off[1:].tolist(), p.n_words.tolist(), strict=True):
            words = whole[a:b].split()
            off = removed[i : i + n]
            gone = int(np.count_nonzero(off))
            if gone:
                words = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            n_removed.append(gone)
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode("utf-8", "replace") if texts else None)
            i += n
        cols = [pa.array(group.id, mask=group.null_id), pa.array(p.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            cols.append(pa.array(kept_text, pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(cols, names=names)

    return work


def repeats_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    bound_batches(docs.sparkSession)
    schema = RESULT + (", kept_text string" if texts else "")
    return rounds(docs, Scratch(docs.sparkSession, "recompress"), id_col, text_col, STEPS, lambda n: _last(n, texts), schema, 28)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
