import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import induced, suffixes


def brute(rows):
    seen, out = set(), []
    for d, t in sorted(((d, t) for d, t in rows), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "日本", "a", "\x00", "", *[f"w{i}" for i in range(60)]]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.choice([20, 40, 80])) for _ in range(8)] + ["=" * 150, "ab" * 90, "x" * 99, "y" * 100, "y" * 101]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 500]
    for _ in range(120):
        texts.append("\n".join(rng.choice([make(rng.randint(0, 30)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 5))))
    texts += texts[20:30] + ["z0" * 20000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [4096, 3])
def test_equals_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = corpus(seed)
    got = sorted(map(tuple, suffixes.repeats_removed(docs_frame(spark, texts).withColumnRenamed("lang", "r")).collect()))
    want = brute(list(enumerate(texts)))
    assert got == want and sum(r[2] for r in want) > 5000


def test_equal_ids_nulls_and_empty(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(20)) * 3 + "".join(map(str, range(60)))
    out = suffixes.repeats_removed(spark.createDataFrame([(5, t), (5, t), (7, "!" + t), (None, t), (None, None)], "doc_id long, text string"), spans=True).collect()
    n = len(t)
    assert sorted((r.doc_id or -1, r.n_removed, [tuple(s) for s in r.spans]) for r in out) == [(-1, 0, []), (-1, n, [(0, n)]), (5, 0, []), (5, n, [(0, n)]), (7, n, [(1, n + 1)])]
    assert suffixes.repeats_removed(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("least", [0, 20, 1 << 17])
@pytest.mark.parametrize("kind", range(8))
def test_suffix_array_equals_sorting(kind, least, monkeypatch):
    monkeypatch.setattr(induced, "LEAST", least)
    rng = np.random.default_rng(kind)
    n = [0, 1, 2, 300, 300, 300, 2000, 1000][kind]
    t = [rng.integers(1, 3, n), np.ones(n, int), rng.integers(1, 300, n), np.tile([1, 2], n // 2), np.tile([3, 1, 2, 1], n // 4), np.arange(n) + 1, rng.integers(1, 4, n), np.full(n, 7)][kind]
    b = [tuple(t[i:].tolist()) for i in range(len(t))]
    assert induced.suffix_array(t).tolist() == sorted(range(len(t)), key=b.__getitem__)


def test_lowest():
    rng = np.random.default_rng(1)
    for n, w in ((5, 5), (200, 7), (64, 8), (9, 1)):
        h = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(24)
        assert suffixes.lowest(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)]


@pytest.mark.parametrize("kind", range(6))
def test_common_prefixes_equal_comparing_every_pair(kind):
    rng = np.random.default_rng(kind)
    t = [np.zeros(0, int), np.array([4]), rng.integers(1, 3, 400), np.full(300, 9), np.tile([1, 2, 300], 90), rng.integers(1, 60000, 300)][kind]
    sa = induced.suffix_array(t)
    want = []
    for i, a in enumerate(sa.tolist()):
        x, y = t[a:].tolist(), t[sa[i - 1] :].tolist() if i else []
        want.append(next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))))
    assert induced.common_prefixes(t, sa).tolist() == want


def test_bytes_that_a_polynomial_could_not_tell_apart(spark):
    n = 2048
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    texts = [one, one.translate({97: 98, 98: 97}), one]
    got = sorted(map(tuple, suffixes.repeats_removed(docs_frame(spark, texts)).collect()))
    assert got == brute(list(enumerate(texts)))


def test_lowest_over_more_places_than_fit(monkeypatch):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(24) | rng.integers(0, 1 << 24, 3000).astype(np.uint64)
    want = suffixes.lowest(h, 9).tolist()
    upper = h >> np.uint64(24)
    assert want == [i + int(np.argmin(upper[i : i + 9])) for i in range(len(h) - 8)]
    monkeypatch.setattr(suffixes, "PLACE", np.uint64(255))
    parts = [suffixes.lowest(upper[i : i + 246 + 8] << np.uint64(24), 9) + i for i in range(0, len(h) - 8, 246)]
    assert np.concatenate(parts).tolist() == want


def test_prints_follow_content_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    p, q = suffixes.Prints(data), suffixes.Prints(data[1000:])
    start = rng.integers(1000, 3800, 200)
    end = start + rng.integers(8, 200, 200)
    for x, y in zip(p.spans(start, end, 4), q.spans(start - 1000, end - 1000, 4)):
        assert (x == y).all()
    seen = {}
    for a, b, x in zip(start.tolist(), end.tolist(), p.spans(start, end, 4)[0].tolist()):
        assert seen.setdefault(x, data[a:b].tobytes()) == data[a:b].tobytes()
    assert (p.all(32, 3)[1000:] == q.all(32, 3)).all()
