"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of ASCII letters, digits and bytes over 0x7F, A-Z lower-cased.
Fixed masks hash some positions of a stretch and ignore the others, so a
substituted token leaves some mask's hash as it was.  Hashes of benchmark items
and of documents are joined; around each hit the two texts are laid over each
other and windows of ``WINDOW`` tokens are compared.  A document is contaminated
by an item if some aligned window of min(item, WINDOW) tokens differs in at most
``allowed(...)`` places.  The masks are lossless for that: any such window holds a
hit of one of them (a test enumerates all cases).

The benchmark's distinct texts, each with the ids of its items, go to tasks in
blocks of at most ``BLOCK_BYTES``; the number of blocks follows its measured size,
so what is broadcast is bounded and every item is compared with every document.
A Python worker builds a block's index once.

Defined cases: null or empty texts and items match nothing; null document and item
ids are carried as nulls; items of fewer tokens than the parameter ``shortest``
(``SHORTEST`` unless given; 1 takes in all) name no passage and are left out;
repeated rows match alike; equal best windows resolve to the first in the document;
empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import bound_batches, table, worker_cache
from wattline.llm.textkit import Words, buffers, lower_ascii, mix, rolling, slices, span_hashes

#: Token positions that count, from the first; each mask spans at most 10 tokens.
MASKS = ((0, 3, 4, 6, 7, 8), (0, 3, 5, 6, 7, 8), (0, 1, 2, 4, 8, 9))
WINDOW = 16
SHORTEST = 5
BLOCK_BYTES = 16 << 20
#: Bytes that an item's id counts for in a block.
ID_BYTES = 16
#: Hits expanded at a time.
HITS = 1 << 18
FILTER_BITS = 20

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = True
_INSIDE[0x80:] = True


def allowed(window: int) -> int:
    """Substitutions that an aligned window may hold."""
    return 3 if window >= 16 else 2 if window >= 14 else 1 if window >= 11 else 0


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token fingerprints, offsets of each text's tokens)."""
    low = lower_ascii(data)
    if len(data):
        up = np.zeros(len(data), bool)
        up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[up] |= 0x20
    words = Words(low, off, _INSIDE)
    return span_hashes(low, words.start, words.end), words.doc


def masked(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of the mask's positions at each place where it fits into ``h``."""
    m = len(h) - mask[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = h[:m].copy()
    for j in mask[1:]:
        x *= np.uint64(0xD6E8FEB86659FD93)
        x += h[j : j + m]
    return mix(x, salt)


class Index:
    """Mask hashes of a block of items, sorted, with their item and place."""

    def __init__(self, texts: list[str], shortest: int = SHORTEST):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.h, self.doc = tokens(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        n = np.diff(self.doc)
        self.short = sorted({int(k) for k in n if max(1, shortest) <= k < 10})
        keys, items, places = [], [], []
        for i, (a, b) in enumerate(zip(self.doc[:-1].tolist(), self.doc[1:].tolist(), strict=True)):
            if b - a in self.short:
                got = [rolling(self.h[a:b], b - a, 100 + b - a)]
            elif b - a >= 10:
                got = [masked(self.h[a:b], m, s) for s, m in enumerate(MASKS)]
            else:
                continue
            for g in got:
                keys.append(g)
                items.append(np.full(len(g), i))
                places.append(np.arange(len(g)))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(items)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if keys else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, h: np.ndarray, doc: np.ndarray):
        """Yield (text, item, window start in the text, window, same tokens): the best window of each text and item of the block."""
        seeds = [(rolling(h, k, 100 + k), k) for k in self.short] + [(masked(h, m, s), m[-1] + 1) for s, m in enumerate(MASKS)]
        n_doc = np.diff(doc)
        text_of = np.repeat(np.arange(len(n_doc)), n_doc)
        found: set[tuple[int, int, int]] = set()
        for x, span in seeds:
            at = np.flatnonzero(self.filter[x >> np.uint64(64 - FILTER_BITS)])
            at = at[at + span <= doc[text_of[at] + 1]]
            lo, hi = np.searchsorted(self.key, x[at], "left"), np.searchsorted(self.key, x[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            reach = np.concatenate([[0], np.cumsum(hi - lo)])
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(reach, reach[i] + HITS, "right")) - 1)
                n = hi[i:j] - lo[i:j]
                entry = np.repeat(lo[i:j] - (reach[i:j] - reach[i]), n) + np.arange(int(n.sum()))
                pos = np.repeat(at[i:j], n)
                text, item = text_of[pos], self.item[entry]
                found.update(zip(text.tolist(), item.tolist(), (pos - doc[text] - self.place[entry]).tolist(), strict=True))
                i = j
        best: dict[tuple[int, int], tuple] = {}
        for t, k, shift in found:
            got = self._verify(h[doc[t] : doc[t + 1]], self.h[self.doc[k] : self.doc[k + 1]], shift)
            if got and ((t, k) not in best or got > best[t, k]):
                best[t, k] = got
        for (t, k), (same, start, window) in sorted(best.items()):
            yield t, k, -start, window, same

    @staticmethod
    def _verify(text: np.ndarray, item: np.ndarray, shift: int):
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        window = min(len(item), WINDOW)
        if b - a < window:
            return None
        run = np.concatenate([[0], np.cumsum(text[a + shift : b + shift] == item[a:b])])
        same = run[window:] - run[:-window]
        k = int(same.argmax())
        return (int(same[k]), -(a + k + shift), window) if same[k] >= window - allowed(window) else None


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """Broadcasts of (texts, ids of each text's items, name of the block), each of about half of ``block_bytes`` at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    n_bytes = items.agg(F.sum(F.octet_length("t") + ID_BYTES)).first()[0] or 0
    blocks = math.ceil(2 * n_bytes / block_bytes) if n_bytes > block_bytes else 1
    texts = items.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i"))).alias("ids"))
    for b in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("t").collect()
        yield spark.sparkContext.broadcast(([r.t for r in part], [[x.i for x in r.ids] for r in part], uuid.uuid4().hex))


def index_of(shared, shortest: int) -> Index:
    """The block's index, built once by a worker that takes task after task."""
    held, key = worker_cache(), (shared.value[2], shortest)
    if held.get("decontam-key") != key:
        held["decontam-key"], held["decontam"] = key, Index(shared.value[0], shortest)
    return held["decontam"]


MATCHES = "item_id long, token_start long, window long, n_same long"


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """id_col, item_id, token_start, window, n_same for each contaminated document and item."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    out = None
    for shared in item_blocks(benchmark, item_col, item_text, block_bytes):

        def run(batches, shared=shared):
            index, ids = index_of(shared, shortest), shared.value[1]
            for batch in batches:
                data, off = buffers(batch.column(1))
                for i, j in slices(off):
                    h, doc = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    rows = [(t, item, *rest) for t, k, *rest in index.find(h, doc) for item in ids[k]]
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        own = batch.column(0).take(pa.array([i + t for t in cols[0]], pa.int64()))
                        yield pa.RecordBatch.from_arrays([own, *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, "item_id", "token_start", "window", "n_same"])

        got = chosen.mapInArrow(run, f"`{id_col}` {kind}, {MATCHES}")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, columns as given; blocks filter one after another, without a shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for shared in item_blocks(benchmark, item_col, item_text, block_bytes):

        def run(batches, shared=shared):
            index = index_of(shared, shortest)
            for batch in batches:
                data, off = buffers(batch.column(at))
                for i, j in slices(off):
                    h, doc = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    keep = np.ones(j - i, bool)
                    keep[[t for t, *_ in index.find(h, doc)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
