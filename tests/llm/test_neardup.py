import random
import re

import pytest

from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import neardup
from wattline.llm.common import Scratch
from wattline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, k, percent):
    s = sets(texts, k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s[i]), find(i)) for i in range(len(s))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É", "é", "The"]
    texts = [None, "", " \n", "a b", "A B", "b a", "x"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                base = w
            texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += ["word " * 60000, "word " * 60000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_frame(spark, texts), shingle=k, percent=percent).collect()}
    want = brute(texts, k, percent)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(want) - 10


def test_chain_and_odd_rows(spark):
    w = [f"t{i}" for i in range(400)]
    texts = [" ".join(w[i * 5 : i * 5 + 150]) for i in range(40)]
    df = docs_frame(spark, texts).unionByName(docs_frame(spark, texts[:1])).unionByName(spark.createDataFrame([(None, texts[0], None, None, 1), (None, None, None, None, None)], DOCS))
    out = neardup.near_duplicates(df, shingle=3, percent=85).collect()
    assert len(out) == 43 and {r.component_id for r in out} == {0, None}
    kept = neardup.deduplicated(df, shingle=3, percent=85)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "None", "None"]
    empty = spark.createDataFrame([], DOCS)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_scratch(spark, tmp_path):
    s = Scratch(spark, "x")
    df = s.put(spark.range(3), "t")
    assert df.count() == 3
    s.close()
    assert s.put(spark.range(2), "t").count() == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}


HEAD = "id long, n long, item long, left long, c long"


def test_bands_of_size_lose_no_pair(spark):
    rng = random.Random(8)
    head = []
    for i in range(400):
        n = rng.choice([1, 2, 3, 7, 20, 100, 100, 101, 118, 119, 5000, 5900])
        for item in rng.sample(range(6), 2):
            head.append((i, n, item, rng.randint(max(1, n * 8 // 10), n), rng.randint(0, 300)))
    for percent in (80, 85):
        got = {tuple(r) for r in neardup.across_components(spark.createDataFrame(head, HEAD), neardup.Plan(5, percent)).collect()}
        want = set()
        for x, nx, i, lx, cx in head:
            for y, ny, j, ly, cy in head:
                if i == j and x < y and cx != cy and min(lx, ly) * (100 + percent) >= percent * (nx + ny) and 100 * min(nx, ny) >= percent * max(nx, ny):
                    want.add((x, y))
        assert got == want and len(want) > 500


def test_template_documents_that_are_not_similar_never_meet(spark):
    one = spark.range(30000).select(F.col("id"), F.lit(100).cast("long").alias("n"), F.lit(7).cast("long").alias("item"), F.lit(91).cast("long").alias("left"), F.col("id").alias("c"))
    assert neardup.across_components(one, neardup.Plan(3, 85)).count() == 0


def test_template_texts_of_many_components(spark):
    rng = random.Random(6)
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base[:30] + [f"own{i}x{j}" for j in range(5)] + base[30:]) for i in range(600)]
    texts += [t.replace("t3 ", f"z{rng.randrange(9)} ") for t in texts[:40]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_frame(spark, texts), shingle=3, percent=85, sigmas=None).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 85)


def test_components_say_when_they_are_not_settled(spark, monkeypatch):
    from wattline.llm import components as C

    monkeypatch.setattr(C, "MAX_ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges, Scratch(spark, "t"), "t")
