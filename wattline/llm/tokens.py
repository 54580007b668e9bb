"""Token-id output in wavelet-matrix shards.

Documents are range-partitioned and sorted by id, encoded with a public tokenizer,
and packed into shards of at most ``SHARD_TOKENS`` tokens (or of one longer slice).
A shard is one compressed file: document ids and lengths, then one bit-plane per id
bit.  Planes are cut into blocks; a directory holds each block's place and the ones
before it, and an opened block counts its ones byte by byte, so rank and select
touch one block and look up instead of counting.  Access, counting and occurrence
lookup work on the compressed file.

Shards are written as plain files through Spark's text writer, one record a file,
so any store Spark can write to will do and the commit protocol covers lost
executors.  ``read_shards`` reads the files back; ``WaveletShard`` takes one's bytes.

Where the tokenizer lower-cases, drops white space and splits as ``SPLIT`` says,
units of words are memoised per Python worker: a word's ids don't depend on its
neighbours then.  Units are found by 64-bit fingerprints and compared byte by byte.
Other tokenizers encode whole texts.

Defined cases: null and empty texts hold only the end id; null ids are ids of their
own and come first; equal ids are ordered by text; an empty table gives no shards;
ids take as many bits as the largest id of the vocabulary.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, bound_batches, shuffle_parts, table, worker_cache
from wattline.llm.textkit import Words, buffers, chunk_view, chunks, lower_ascii, slices, span_hashes

SHARD_TOKENS = 1 << 21
#: Text that a range partition holds about; each partition is encoded by one task.
PART_BYTES = 32 << 20
BLOCK_BITS = 1 << 18
#: Blocks that a shard keeps open.
OPEN_BLOCKS = 64
MAGIC = b"WMX2"
#: Magic, bits an id, range partition, shard in it, ids of the partition before it, ids, documents, documents with a null id (the first).
HEAD = "<4sIQQQQQQ"
END_ID = 2
#: Units remembered by a worker.
MEMO_UNITS = 500_000


class Block:
    """A block of a bit-plane with its count of ones up to each byte."""

    def __init__(self, raw: bytes, n: int):
        self.bytes, self.n = np.frombuffer(raw, np.uint8), n
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bytes), dtype=np.int64)])

    def bit(self, i: int) -> int:
        return int(self.bytes[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        part = (int(self.bytes[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else 0
        return int(self.ones[i >> 3]) + part

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to ``bit``."""
        ahead = self.ones if bit else 8 * np.arange(len(self.ones)) - self.ones
        byte = int(np.searchsorted(ahead, k, "right")) - 1
        at = np.flatnonzero(np.unpackbits(self.bytes[byte : byte + 1]) == bit)
        return 8 * byte + int(at[k - int(ahead[byte])])


class WaveletShard:
    """A wavelet matrix over 0..2**bits-1 in one compressed image."""

    def __init__(self, image: bytes):
        self.image = image
        magic, self.bits, self.part, self.seq, self.ahead, self.n, docs, self.n_null = struct.unpack_from(HEAD, image, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.doc_len = np.frombuffer(image, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        blocks = -(-self.n // BLOCK_BITS)
        self.zeros = np.frombuffer(image, "<u8", self.bits, at)
        at += 8 * self.bits
        self.place = np.frombuffer(image, "<u8", self.bits * blocks + 1, at)
        at += 8 * (self.bits * blocks + 1)
        self.before = np.frombuffer(image, "<u8", self.bits * blocks, at).reshape(self.bits, blocks)
        self.body = at + 8 * self.bits * blocks
        self.blocks = blocks
        self._open: dict[int, Block] = {}

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, doc_len: np.ndarray, bits: int = 16, *, part: int = 0, seq: int = 0, ahead: int = 0, n_null: int = 0) -> bytes:
        n = len(ids)
        if n and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        blocks = -(-n // BLOCK_BITS)
        zip_ = zstandard.ZstdCompressor(level=1)
        seq_ = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, before, parts = [], [], []
        for level in range(bits):
            bit = (seq_ & seq_.dtype.type(1 << (bits - 1 - level))) != 0
            starts = range(0, n, BLOCK_BITS)
            ones = [np.count_nonzero(bit[s : s + BLOCK_BITS]) for s in starts]
            before.append(np.cumsum([0, *ones[:-1]]) if blocks else np.zeros(0, np.int64))
            packed = np.packbits(bit).tobytes()
            parts += [zip_.compress(packed[s // 8 : s // 8 + BLOCK_BITS // 8]) for s in starts]
            low = seq_[~bit]
            zeros.append(len(low))
            seq_ = np.concatenate([low, seq_[bit]])
        place = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u8")
        head = struct.pack(HEAD, MAGIC, bits, part, seq, ahead, n, len(doc_ids), n_null)
        return b"".join([head, np.asarray(doc_ids).astype("<i8").tobytes(), np.asarray(doc_len).astype("<u8").tobytes(), np.array(zeros, "<u8").tobytes(), place.tobytes(), np.array(before, "<u8").tobytes(), *parts])

    def _raw(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.image[self.body + int(self.place[k]) : self.body + int(self.place[k + 1])])

    def _block(self, level: int, block: int) -> Block:
        k = level * self.blocks + block
        if k not in self._open:
            if len(self._open) >= OPEN_BLOCKS:
                self._open.pop(next(iter(self._open)))
            self._open[k] = Block(self._raw(k), min(BLOCK_BITS, self.n - block * BLOCK_BITS))
        return self._open[k]

    def rank(self, level: int, bit: int, i: int) -> int:
        """Entries equal to ``bit`` among the first i of a plane."""
        if i >= self.n:
            ones = self.n - int(self.zeros[level])
        elif i <= 0:
            ones = 0
        else:
            b = i // BLOCK_BITS
            ones = int(self.before[level, b]) + self._block(level, b).rank(i - b * BLOCK_BITS)
        return ones if bit else min(max(i, 0), self.n) - ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) entry equal to ``bit`` in a plane."""
        starts = np.arange(self.blocks, dtype=np.int64) * BLOCK_BITS
        ones = self.before[level].astype(np.int64)
        ahead = ones if bit else starts - ones
        b = int(np.searchsorted(ahead, k, "right")) - 1
        return b * BLOCK_BITS + self._block(level, b).select(bit, k - int(ahead[b]))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            b = i // BLOCK_BITS
            bit = self._block(level, b).bit(i - b * BLOCK_BITS)
            value = value << 1 | bit
            i = self.rank(level, bit, i) + (int(self.zeros[level]) if bit else 0)
        return value

    def _range(self, token: int) -> tuple[int, int]:
        lo, hi = 0, self.n
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            base = int(self.zeros[level]) if bit else 0
            lo, hi = self.rank(level, bit, lo) + base, self.rank(level, bit, hi) + base
        return lo, hi

    def count(self, token: int) -> int:
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token)
        return hi - lo

    def find(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token)[0] + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self.select(level, bit, i - (int(self.zeros[level]) if bit else 0))
        return i

    def decode(self) -> np.ndarray:
        """All ids in order; planes are merged from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            k = level * self.blocks
            raw = b"".join(self._raw(j) for j in range(k, k + self.blocks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool) if self.n else np.zeros(0, bool)
            z = int(self.zeros[level])
            up = np.empty(self.n, kind)
            up[~bit] = seq[:z]
            up[bit] = seq[z:] | kind(1 << (self.bits - 1 - level))
            seq = up
        return seq


#: Fixed value: the expression by which the memoised tokenizer splits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def configuration(tokenizer) -> dict:
    """A tokenizer's configuration without its vocabulary, which takes tens of megabytes as JSON."""
    state = lambda part: None if part is None else json.loads(part.__getstate__())
    model = tokenizer.model
    kind = {"type": type(model).__name__, "end_of_word_suffix": getattr(model, "end_of_word_suffix", None), "dropout": getattr(model, "dropout", None)}
    added = [{"content": t.content, "normalized": t.normalized} for t in tokenizer.get_added_tokens_decoder().values()]
    return {"normalizer": state(tokenizer.normalizer), "pre_tokenizer": state(tokenizer.pre_tokenizer), "post_processor": state(tokenizer.post_processor), "model": kind, "added_tokens": added}


def splits_into_units(config: dict) -> bool:
    """Whether ``pieces`` cuts texts as this tokenizer does."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = config.get("model", {})
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and not (cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"))
        and config.get("post_processor") is None
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and all(str(t.get("content", "")).startswith("<|") and not t.get("normalized") for t in config.get("added_tokens", []))
    )


#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 anything whose tokens may depend on its neighbours.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x27] = 4
#: Second bytes after 0xC3 that are no letters.
_SIGNS = (0x97, 0xB7)


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units that are encoded on their own: (starts, ends, plain, index of each text's units, bytes in lower case).

    A word of ASCII and U+00C0..U+00FF letters, digits and marks falls into runs of
    letters, single digits and runs of marks, one pre-token each (plain); a word
    with any other character is one unit.
    """
    n = len(data)
    words = Words(data, off)
    kind = _CLASS[data]
    low = lower_ascii(data)
    if n:
        after = np.zeros(n, bool)
        after[1:] = data[:-1] == 0xC3
        good = after & (data >= 0x80) & (data <= 0xBF) & (data != _SIGNS[0]) & (data != _SIGNS[1])
        kind[good] = 1
        kind[np.flatnonzero(good) - 1] = 1
        low[good & (data <= 0x9E)] |= 0x20
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        kind[special] = 4
    total = np.concatenate([[0], np.cumsum(kind == 4)])
    odd = total[words.end] > total[words.start]
    mark = np.zeros(n + 1, np.int32)
    mark[words.start[odd]] = 1
    mark[words.end[odd]] -= 1
    odd_byte = np.cumsum(mark)[:n] > 0
    low = np.where(odd_byte, data, low)
    begin = np.zeros(n, bool)
    if n:
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin &= (kind > 0) & ~odd_byte
        begin[words.start] = True
    starts = np.flatnonzero(begin)
    which = np.searchsorted(words.start, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), words.end[which]) if len(starts) else starts
    return starts, ends, ~odd[which], np.searchsorted(starts, off), low


class Encoder:
    """Ids of texts as one array.

    Ids of units are remembered in an open-addressing table under 64-bit fingerprints,
    beside the units' bytes; it is emptied when it holds ``MEMO_UNITS``.
    """

    SLOTS = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.by_units = splits_into_units(configuration(self.tokenizer))
        self.bits = max(max(vocab.values()), END_ID).bit_length()
        self.ends_unit = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_unit[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self, units: int = 0):
        """Forget all units; make room for so many."""
        self.slots = max(self.SLOTS, 1 << (2 * units).bit_length())
        self.keys = np.zeros(self.slots, np.uint64)
        self.vals = np.zeros(self.slots, np.int32)
        self.pool, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        #: The units' bytes as 8-byte numbers, where each unit's begin, and its size and kind.
        self.bytes, self.bytes_at, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.known = self.n_bytes = 0
        #: Units whose fingerprint another unit has.
        self.odd: dict[tuple[bytes, bool], int] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each fingerprint, or -1."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def _store(self, h: np.ndarray) -> None:
        """Give the next indexes to new, distinct fingerprints."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slot[took]] = h[todo[took]]
            self.vals[slot[took]] = self.known + todo[took]
            more = np.ones(len(todo), bool)
            more[took] = False
            todo, slot = todo[more], (slot[more] + (self.keys[slot[more]] != 0)) & (self.slots - 1)

    def _append(self, ids: np.ndarray, ends: np.ndarray) -> None:
        base = int(self.ends[self.known - 1]) if self.known else 0
        self.pool = _room(self.pool, base + len(ids))
        self.ends = _room(self.ends, self.known + len(ends))
        self.pool[base : base + len(ids)] = ids
        self.ends[self.known : self.known + len(ends)] = base + ends
        self.known += len(ends)

    def _ids(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _learn(self, units: list[bytes], plain: np.ndarray) -> None:
        """Encode new units and keep their bytes: plain ones first, many at a time through the tokenizer."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        raw = [units[i] for i in order.tolist()]
        size = np.array([len(u) for u in raw], np.int64)
        end = np.cumsum(size)
        c, first, _ = chunks(chunk_view(np.frombuffer(b"".join(raw), np.uint8)), end - size, end)
        more = self.known + len(raw)
        self.bytes, self.bytes_at, self.size = _room(self.bytes, self.n_bytes + len(c)), _room(self.bytes_at, more), _room(self.size, more)
        self.bytes[self.n_bytes : self.n_bytes + len(c)] = c
        self.bytes_at[self.known : more] = self.n_bytes + first
        self.size[self.known : more] = 2 * size + plain[order]
        self.n_bytes += len(c)
        simple = [u.decode() for u in raw[: int(plain.sum())]]
        for i in range(0, len(simple), 2000):
            part = simple[i : i + 2000]
            ids = self._ids([" ".join(part)])[0]
            ends = np.flatnonzero(self.ends_unit[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a unit is not one pre-token")
            self._append(ids, ends)
        got = self._ids([u.decode("utf-8", "replace") for u in raw[len(simple) :]])
        if got:
            self._append(np.concatenate(got), np.cumsum([len(x) for x in got]))

    def _differ(self, at: np.ndarray, c: np.ndarray, first: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Units whose remembered namesake has other bytes."""
        off = self.size[at] != size
        n = (size >> 4) + ((size >> 1 & 7) > 0)
        mine = np.minimum(np.repeat(self.bytes_at[at], n) + place, self.n_bytes - 1)
        apart = (self.bytes[mine] != c).astype(np.int64)
        if len(c):
            off |= np.add.reduceat(apart, first) > 0
        return np.flatnonzero(off)

    def _fingerprints(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, view: np.ndarray) -> np.ndarray:
        return (span_hashes(low, starts, ends, view=view) | np.uint64(1)) ^ (plain.astype(np.uint64) << np.uint64(1))

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length of each text's ids), with ``end_id`` after each text."""
        if not self.by_units:
            whole, at = data.tobytes(), off.tolist()
            got = self._ids([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
            doc_len = np.array([len(x) for x in got], np.int64)
            return _with_ends(np.concatenate([*got, np.zeros(0, np.uint32)]), doc_len, end_id)
        starts, ends, plain, doc, low = pieces(data, off)
        view = chunk_view(low)
        h = self._fingerprints(low, starts, ends, plain, view)
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        whole = low.tobytes() if len(miss) else b""
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.known + len(new) > MEMO_UNITS and (self.known or 2 * len(new) > self.slots):
                self._clear(len(np.unique(h)) if self.known else len(new))
                return self.encode(data, off, end_id)
            first = miss[first]
            # Indexes are handed out in the order in which _learn appends.
            order = np.concatenate([np.flatnonzero(plain[first]), np.flatnonzero(~plain[first])])
            self._store(new[order])
            self._learn([whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], plain[first])
            at[miss] = self._find(h[miss])
        c, first, place = chunks(view, starts, ends)
        for i in self._differ(at, c, first, place, 2 * (ends - starts) + plain).tolist():
            unit = (low[starts[i] : ends[i]].tobytes(), bool(plain[i]))
            if unit not in self.odd:
                self.odd[unit] = self.known
                self._learn([unit[0]], plain[i : i + 1])
            at[i] = self.odd[unit]
        begin = np.where(at > 0, self.ends[at - 1], 0)
        length = self.ends[at] - begin
        doc_len = np.diff(np.concatenate([[0], np.cumsum(length)])[doc])
        shift = np.cumsum(length) - length
        ids = self.pool[np.repeat(begin - shift, length) + np.arange(int(length.sum()))]
        return _with_ends(ids, doc_len, end_id)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it has n places."""
    while n > len(held):
        held = np.concatenate([held, np.zeros(len(held), held.dtype)])
    return held


def _with_ends(ids: np.ndarray, doc_len: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, doc_len
    out = np.full(len(ids) + len(doc_len), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(doc_len + 1) - 1] = False
    out[keep] = ids
    return out, doc_len + 1


def encoder(path: str) -> Encoder:
    held = worker_cache()
    if held.get("path") != path:
        held["path"], held["encoder"] = path, Encoder(path)
    return held["encoder"]


def range_parts(docs: DataFrame, text_col: str) -> int:
    """Range partitions of about ``PART_BYTES`` of text, at least as many as a shuffle has."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), math.ceil(size / PART_BYTES))


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Write one file a shard to ``folder``; ids ascend within a shard, from shard to shard and from range partition to range partition."""
    bound_batches(docs.sparkSession)

    def pack(batches):
        enc, part, seq, ahead = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        bits = max(enc.bits, int(end_id).bit_length())
        ids, lens, names, nulls, held = [], [], [], 0, 0

        def flush():
            nonlocal ids, lens, names, nulls, held, seq, ahead
            image = WaveletShard.build(np.concatenate(ids), np.concatenate(names), np.concatenate(lens), bits, part=part, seq=seq, ahead=ahead, n_null=nulls)
            ahead, seq = ahead + held, seq + 1
            ids, lens, names, nulls, held = [], [], [], 0, 0
            return pa.RecordBatch.from_pydict({"image": pa.array([image], pa.binary())})

        for batch in batches:
            data, off = buffers(batch.column(1))
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                got, length = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                if held and held + len(got) > shard_tokens:
                    yield flush()
                ids.append(got.astype(np.uint16 if bits <= 16 else np.uint32))
                lens.append(length)
                names.append(doc_ids[i:j])
                nulls += int(missing[i:j].sum())
                held += len(got)
        if names:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on, beside the executor's heap

    n = partitions or range_parts(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows with one id are dealt by the head of their text, in whose order they are sorted too.
    dealt = rows.repartitionByRange(n, F.asc("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(pack, "image binary").select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").mode("overwrite").text(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard files of a folder, as written: path, content."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""
    bound_batches(spark, 1)
    head = F.substring("content", 1, struct.calcsize(HEAD))

    def heads(batches):
        for batch in batches:
            got = [struct.unpack(HEAD, x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([g[2] for g in got], pa.int64()), "n": pa.array([g[5] for g in got], pa.int64())})

    files = read_shards(spark, folder)
    totals = files.select(head.alias("head")).mapInArrow(heads, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts, run = {}, 0
    for r in totals:
        starts[r.part], run = run, run + r.n

    def unpack(batches):
        for batch in batches:
            for image in batch.column(0):
                shard = WaveletShard(image.as_py())
                raw = memoryview(shard.decode().astype("<u4").tobytes())
                ends = np.cumsum(shard.doc_len.astype(np.int64))
                first = ends - shard.doc_len.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                names = pa.array(shard.doc_ids, mask=np.arange(len(first)) < shard.n_null)
                yield pa.RecordBatch.from_pydict({"doc_id": names, "start": first + (starts[shard.part] + shard.ahead), "n_tokens": ends - first, "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("content").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write shard files to the shared folder and return the documents that are read back from them."""
    folder = Scratch(docs.sparkSession, "tokens").root + "/shards"
    write_shards(docs, tokenizer_path, folder, **how)
    return read_documents(docs.sparkSession, folder)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
