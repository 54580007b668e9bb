import itertools
import random
import re

import pytest

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import decontam as D

ITEM = "item_id long, text string"


def toks(t):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def brute(texts, items):
    out = set()
    for d, t in enumerate(texts):
        a = toks(t)
        for k, it in enumerate(items):
            b = toks(it)
            w = min(len(b), D.WINDOW)
            if len(b) < D.SHORTEST:
                continue
            for i in range(len(a) - w + 1):
                for j in range(len(b) - w + 1):
                    if sum(x == y for x, y in zip(a[i : i + w], b[j : j + w])) >= w - D.allowed(w):
                        out.add((d, k))
    return out


@pytest.mark.parametrize("window", range(10, 17))
def test_masks_are_lossless(window):
    for s in map(set, itertools.combinations(range(window), D.allowed(window))):
        assert any(all(o + j not in s for j in m) for m in D.MASKS for o in range(window - m[-1])), s


def corpus():
    rng = random.Random(5)
    vocab = ["the", "of", "to", *[f"w{i}" for i in range(60)], "été", "ÉTÉ"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(n) for n in (3, 5, 7, 10, 12, 15, 16, 20, 40)]
    texts = [None, "", "a b c"]
    for _ in range(150):
        body = make(rng.randint(5, 60))
        if rng.random() < 0.7:
            it = list(rng.choice(items))
            for _ in range(rng.randint(0, 4)):
                it[rng.randrange(len(it))] = rng.choice(vocab)
            cut = rng.randint(0, 5)
            body[10:10] = it[cut:] if rng.random() < 0.5 else it
        texts.append(rng.choice([" ", "\n", " - "]).join(w.title() if rng.random() < 0.2 else w for w in body) + "***")
    texts.append("the " * 5000)
    items.append(["the"] * 20)
    return texts, [" ".join(i) for i in items] + [None, ""]


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 200])
def test_equals_brute_force(spark, block):
    texts, items = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = D.matches(docs_frame(spark, texts), bench, block_bytes=block).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    want = brute(texts, items)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 40
    kept = D.clean(docs_frame(spark, texts), bench, block_bytes=block)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], ITEM)
    assert D.matches(none, bench).count() == 0
    assert D.clean(docs_frame(spark, ["a b c", None]), bench).count() == 2


def test_null_ids_copies_and_short_items(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(None, t), (4, t), (4, t), (5, "lone"), (6, None), (7, "one two")], ITEM)
    docs = spark.createDataFrame([(1, "x " + t), (None, t), (2, "a lone word")], "doc_id long, text string")
    rows = D.matches(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.token_start) for r in rows) == sorted([("1", "None", 1), ("1", "4", 1), ("1", "4", 1), ("None", "None", 0), ("None", "4", 0), ("None", "4", 0)])
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]
    rows = D.matches(docs, bench, shortest=1, block_bytes=40).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, None) for i in (None, 4, 7)} | {(2, 5)}
