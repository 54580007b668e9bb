import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import tokens

P = pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(0)
    al = ["a", "B", "é", "É", "×", "ß", "'s", "'", "<|endoftext|>", "<|", "1", "23", ".,", "́", "H̱", "İ", "日本", " ", " ", "\x1c", "\x00", "\n", "’", "½", "_"]
    return [None, "", "  \n", "hello, World's end"] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["long text " * 30000]


def test_round_trip_equals_library(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tx = texts()
    got = {r.doc_id: r for r in tokens.tokenize(docs_frame(spark, tx).repartition(3), path, shard_tokens=5000).collect()}
    tk, start = Tokenizer.from_file(path), 0
    assert len(got) == len(tx)
    for i, t in enumerate(tx):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (i, t)
        start += len(ids)


def test_empty_table_and_repeated_ids(spark):
    path = P.path("word_bpe_49k.json")
    assert tokens.tokenize(spark.createDataFrame([], DOCS), path).count() == 0
    df = spark.createDataFrame([(1, "b"), (1, "a"), (0, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start) for r in tokens.tokenize(df, path).collect()) == [(0, 0), (1, 2), (1, 4)]


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_wavelet_queries(n, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BITS", 1 << 9)
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 1, 2, 500, 49407, 65535], n).astype(np.uint32)
    w = tokens.WaveletShard(tokens.WaveletShard.build(ids, np.arange(1), np.array([n])))
    assert (w.decode() == ids).all()
    for i in rng.integers(0, n, 30) if n else []:
        assert w.access(int(i)) == ids[i]
    for t in (0, 2, 500, 65535, 77):
        at = np.flatnonzero(ids == t)
        assert w.count(t) == len(at)
        for k in range(min(5, len(at))):
            assert w.find(t, k) == at[k]
    with pytest.raises(IndexError):
        w.find(77, 0)


def test_null_ids_wide_ids_and_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(-1, "a"), (None, "b c"), (-9, "d"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.tokenize(df, path).collect())
    assert got == [(0, None, 1), (1, None, 3), (4, -9, 2), (6, -1, 2)]
    with pytest.raises(ValueError):
        tokens.WaveletShard.build(np.array([70000]), np.array([1]), np.array([1]))
    wide = tokens.WaveletShard(tokens.WaveletShard.build(np.array([70000, 4464, 70000]), np.array([1]), np.array([3]), 17))
    assert wide.decode().tolist() == [70000, 4464, 70000] and wide.count(70000) == 2 and wide.find(70000, 1) == 2 and wide.count(1 << 20) == 0
    tokens.write_shards(df, path, f"file://{tmp_path}/shards", shard_tokens=2, partitions=1)
    images = [f.read_bytes() for f in sorted((tmp_path / "shards").glob("part-*"))]
    assert all(x.startswith(tokens.MAGIC) for x in images) and sum(tokens.WaveletShard(x).n for x in images) == 8


def test_equal_ids_spread_over_partitions(spark):
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(7, f"w{i:04d} x") for i in range(500)] + [(8, "z")], "doc_id long, text string")
    rows = sorted(tokens.tokenize(df, path, partitions=8).collect(), key=lambda r: r.start)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert len(rows) == 501 and rows[-1].doc_id == 8


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tx = texts()[:200]
    assert not tokens.Encoder(path).by_units
    got = {r.doc_id: r for r in tokens.tokenize(docs_frame(spark, tx), path).collect()}
    tk = Tokenizer.from_file(path)
    for i, t in enumerate(tx):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def encoded(enc, tx):
    raw = [(t or "").encode() for t in tx]
    return enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 2)


@pytest.mark.parametrize("bits", [0, 3])
def test_units_with_one_fingerprint_keep_their_own_ids(monkeypatch, bits):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tx = texts()[:120] + ["abcdefgh abcdefghi abcdefghij", "abcdefghz 12 abcdefghiz"]
    plain = encoded(tokens.Encoder(path), tx)
    tk = Tokenizer.from_file(path)
    assert plain[0].tolist() == [i for t in tx for i in tk.encode(t or "", add_special_tokens=False).ids + [2]]
    real = tokens.Encoder._fingerprints
    monkeypatch.setattr(tokens.Encoder, "_fingerprints", lambda *a: (real(*a) & np.uint64((1 << bits) - 1)) + np.uint64(1))
    enc = tokens.Encoder(path)
    for _ in range(2):
        ids, length = encoded(enc, tx)
        assert (ids == plain[0]).all() and (length == plain[1]).all()
    assert enc.odd


def test_words_that_a_polynomial_could_not_tell_apart():
    n = 1024
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    two = "".join("ba"[bin(i).count("1") % 2] for i in range(n))
    ids, length = encoded(tokens.Encoder(P.path("word_bpe_49k.json")), [one, two])
    assert ids[: length[0]].tolist() != ids[length[0] :].tolist()


def test_more_units_than_the_memo_holds(monkeypatch):
    path = P.path("word_bpe_49k.json")
    tx = texts()[:100] + [" ".join(f"u{i}x" for i in range(400))]
    want = encoded(tokens.Encoder(path), tx)
    monkeypatch.setattr(tokens, "MEMO_UNITS", 10)
    monkeypatch.setattr(tokens.Encoder, "SLOTS", 16)
    enc = tokens.Encoder(path)
    assert enc.by_units and not tokens.Encoder(P.path("byte_bpe_50k.json")).by_units
    for part in (tx, tx[:3], tx[50:]):
        ids, length = encoded(enc, part)
        first = encoded(tokens.Encoder(path), part)
        assert (ids == first[0]).all() and (length == first[1]).all()
    assert (encoded(enc, tx)[0] == want[0]).all()
