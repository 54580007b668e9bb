import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_neardup, test_quality_urls_mixing
from tests.llm.conftest import DOCS
from wattline.llm import mixing, quality

P = pytest.importorskip("public_tokenizers")


def passage(rng, n):
    return [rng.choice("alpha beta gamma delta river stone window garden yellow market simple people".split()) + str(rng.randrange(400)) for _ in range(n)]


def corpus():
    rng = random.Random(11)
    bench = [" ".join(passage(rng, 30)) for _ in range(6)]
    rows = []
    for _ in range(220):
        w = passage(rng, rng.randint(55, 150))
        if rng.random() < 0.1:
            w[20:20] = rng.choice(bench).split()
        rows.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            rows.append(" ".join(v))
    rows += [None, "", "short text", "### " * 80, "same words " * 60, rows[0], rows[0]]
    docs = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(rows)]
    return docs, bench


def expected(docs, bench):
    """The five stages by brute force; also every stage's surviving ids."""
    texts = [(t or "").encode() for _, t, *_ in docs]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kept = quality.cascade(quality.Features(np.frombuffer(b"".join(texts), np.uint8), off), list(quality.RULES), quality.Limits())
    base = [not test_quality_urls_mixing.brute(t)[-1] for _, t, *_ in docs]
    assert all(b for k, b in zip(kept, base) if k)
    rows = [d for d, k in zip(docs, kept) if k]
    roots = test_neardup.brute([t for _, t, *_ in rows], 5, 80)
    rows = [d for i, d in enumerate(rows) if roots[i][1] == i]
    bad = {d for d, _ in test_decontam.brute([t for _, t, *_ in rows], bench)}
    return [d for i, d in enumerate(rows) if i not in bad]


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, bench = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, clean = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, out, str(tmp_path))
        assert out.columns == [x.split()[0] for x in DOCS.split(", ")]
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k == 2:
            clean = out.collect()
    rows = expected(docs, bench)
    assert sorted(map(tuple, clean)) == sorted(rows) and 100 < len(rows) < 220
    sizes = {s: sum(len(d[1].split()) for d in rows if d[3] == s) for s in ("a", "b", "c", None)}
    target = dict(zip(sizes, mixing.quotas(list(sizes.values()), [5, 2, 1, 5], 1.5, 2)))
    mixed = out.collect()
    texts = {d[0]: d for d in rows}
    uses = {}
    for r in mixed:
        assert tuple(r) == texts[r.doc_id]
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(uses.values()) <= 2
    for s, t in target.items():
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - t) <= 180
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    for i in sorted(r.doc_id for r in mixed):
        ids = tk.encode(texts[i][1], add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_nulls_pass_through(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["id", "n", "h", "pattern", "bucket", "members", "size", "rep", "key", "kept", "copies", "component_id", "item_id", "plan", "words", "whole", "last"]
    df = spark.createDataFrame(docs + [(None, None, None, None, None)] * 2, DOCS).selectExpr("*", *[f"doc_id * {i} AS `{c}`" for i, c in enumerate(names)])
    plain = spark.createDataFrame(docs + [(None, None, None, None, None)] * 2, DOCS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        got, want = stage(spark, df, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert got.columns == df.columns
        rows = got.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in want.collect())
        assert all(r[c] == r.doc_id * i for r in rows if r.doc_id is not None for i, c in enumerate(names))
    wide = corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path))
    assert sorted(map(str, wide.collect())) == sorted(map(str, corpus_pipeline.STAGES[4][1](spark, plain, str(tmp_path)).collect()))
