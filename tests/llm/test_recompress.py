import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import recompress as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "a", "a", "b", "été", *[f"w{i}" for i in range(40)]]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 50]))] for _ in range(8)]
    passages += [["a"] * 30, ["a", "b"] * 20, ["x"] * 12 + ["y"], ["z", "a", "a"] * 9]
    texts = [None, "", " \n", " ".join(["a"] * 12), " ".join(["a"] * 13), " ".join(["a"] * 14), "lone"]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 15))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                i = rng.randint(0, 3)
                w += p[i:] if rng.random() < 0.5 else p
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += texts[20:30] + ["q r " * 20000, "q r " * 100]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    got = sorted(map(tuple, R.repeats_removed(docs_frame(spark, texts).withColumnRenamed("n_chars", "g")).collect()))
    want = brute(list(enumerate(texts)))
    assert got == want and sum(r[2] for r in want) > 1000


def test_equal_ids_and_nulls(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t), (5, t), (7, t), (None, t), (None, None)]
    out = R.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.kept_text) for r in out) == [(-1, 0, ""), (-1, 30, ""), (5, 0, t), (5, 0, t), (7, 30, "")]
    assert R.repeats_removed(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[1:3] for r in R.repeats_removed(spark.createDataFrame([(1, "short")], "doc_id long, text string")).collect()] == [(1, 0)]


def anchors(h, doc):
    part = R.Slice(h, doc)
    for _ in range(R.ROUNDS):
        part.take(part.blocks().key & ~R.WORD)
    return part.anchors()


def test_windows_pick_by_their_words_alone():
    rng = np.random.default_rng(0)
    seen = {}
    for _ in range(400):
        n = int(rng.integers(13, 90))
        h = rng.choice(rng.integers(1, 6, 1)[0] + 1, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
        key = anchors(h, np.array([0, n]))
        for i in range(n - 12):
            k = h[i : i + 13].tobytes()
            assert key[i] != 0 and seen.setdefault(k, key[i]) == key[i]
        assert not key[n - 12 :].any()


def test_blocks_of_one_key_keep_apart(monkeypatch):
    rng = np.random.default_rng(1)
    a, b, l = (rng.integers(0, 4, 300).astype(np.uint64) for _ in range(3))
    blocks = R.Triples(a, b, l)
    blocks.key = a % np.uint64(2)
    names, index, first = blocks.distinct()
    assert len(names) == len(set(zip(a.tolist(), b.tolist(), l.tolist())))
    assert (index[first] == np.arange(len(names))).all() and all(index.tolist().index(i) == k for i, k in enumerate(first.tolist()))
    assert (names.a[index] == a).all() and (names.b[index] == b).all() and (names.l[index] == l).all()


def test_words_that_a_polynomial_could_not_tell_apart(spark):
    n = 1024
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    two = "".join("ba"[bin(i).count("1") % 2] for i in range(n))
    w = [f"w{i}" for i in range(20)]
    texts = [" ".join(w[:8] + [x] + w[8:]) for x in (one, two, one)]
    got = sorted(map(tuple, R.repeats_removed(docs_frame(spark, texts)).collect()))
    assert got == brute(list(enumerate(texts))) and [r[2] for r in got] == [0, 0, 21]
