import random
import zlib

import numpy as np

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import langid

STOCK = {
    "en": "the and of that with thing ing tion there have would people",
    "fr": "le la des une être avec pour dans êtes où très français",
    "de": "der die und nicht über schön ein werden straße können",
}


def rows(n):
    rng = random.Random(0)
    out = []
    for i in range(n):
        lang = rng.choice(list(STOCK))
        out.append((i, " ".join(rng.choice(STOCK[lang].split()) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return out


def test_held_out_accuracy(spark, tmp_path):
    data = rows(900)
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in langid.op5(spark, str(tmp_path)).collect()}
    again = {r.doc_id: r for r in langid.op5(spark, str(tmp_path)).collect()}
    assert got == again and len(got) == 900
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_cases(spark):
    texts, labels = [r[1].encode() for r in rows(200)], [r[2] for r in rows(200)]
    model = langid.train(texts, labels)
    cases = [None, "", "123 !? —", "x", "über " * 50000, "日本語", "½ ²", "über " * 50000]
    got = {r.doc_id: r for r in langid.identify(docs_frame(spark, cases), model).collect()}
    for i in (0, 1, 2):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[3].lang_pred in STOCK and got[4].lang_pred == "de" and got[5].lang_pred in STOCK and got[6].lang_pred == "und"
    assert got[4].score == got[7].score
    assert {r.lang_pred for r in langid.identify(docs_frame(spark, ["a"]), None).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_batching_never_changes_a_score():
    texts, labels = [r[1].encode() for r in rows(100)], [r[2] for r in rows(100)]
    model = langid.train(texts, labels)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = model.logits(data, off)
    for i in range(100):
        assert (model.logits(data[off[i] : off[i + 1]], np.array([0, len(texts[i])])) == whole[i]).all()


def test_sample_fills_up_where_texts_are_copied(spark):
    copied = [(i, f"straße {i % 30} und kein weg", "de") for i in range(12000)]
    docs = spark.createDataFrame([*copied, *[(20000 + i, f"the road {i}", "en") for i in range(40)]], "doc_id long, text string, lang string")
    texts, labels = langid.sample(docs, docs.doc_id.isNotNull())
    assert len(set(texts)) == len(texts) and labels.count("de") == 30 and labels.count("en") == 40


def brute_logits(model, text):
    """Mean of the table's entries over every n-gram, one at a time."""
    data = bytearray(text)
    letter = [65 <= c <= 90 or 97 <= c <= 122 or c >= 0x80 for c in data]
    low = bytearray(data)
    for i, c in enumerate(data):
        if 65 <= c <= 90 or (i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            low[i] |= 0x20
        if not letter[i]:
            low[i] = 0x20
    total, n = np.zeros(len(model.langs), np.int64), 0
    for k in langid.GRAMS:
        for i in range(len(low) - k + 1):
            if all(letter[i + 1 : i + k - 1]) and (letter[i] or letter[i + k - 1]):
                h = int.from_bytes(low[i : i + k], "big") ^ (k * 0x9E3779B1 & 0xFFFFFFFF)
                h = h * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
                h = h * 0xC2B2AE35 & 0xFFFFFFFF
                total += model.table[:, h >> (32 - langid.BUCKET_BITS)]
                n += 1
    return total / (langid._FIXED * max(n, 1)) + model.bias


def test_prediction_equals_brute_force():
    texts, labels = [r[1].encode() for r in rows(200)], [r[2] for r in rows(200)]
    model = langid.train(texts, labels)
    cases = [*texts[:20], b"", b"x", b"A b", "\u00c9T\u00c9 \u00d7 !a1b2".encode(), b"  ab  cd-ef ", "\u65e5\u672c".encode()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in cases])])
    got = model.logits(np.frombuffer(b"".join(cases), np.uint8), off)
    assert np.allclose(got, [brute_logits(model, t) for t in cases], rtol=0, atol=1e-9)


def test_every_language_is_learned_however_many(spark):
    rng = random.Random(3)
    names = [f"l{i:03d}" for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(f"{names[i % 150]}{rng.choice('abcdef')}q" for _ in range(12)), names[i % 150]) for i in range(1500)], "doc_id long, text string, lang string")
    texts, labels = langid.sample(docs, docs.doc_id.isNotNull())
    assert len(set(labels)) == 150 and len(texts) <= langid.SAMPLE_ROWS
    assert langid.train(texts, labels).langs == names


def test_null_ids_and_clashing_columns(spark, tmp_path):
    extra = [(None, "der die und", "de", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows(300) + extra, DOCS).selectExpr("*", "1 AS h", "2 AS below", "'x' AS lang_pred", "3 AS score", "4 AS __text")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op5(spark, str(tmp_path)).collect()
    assert len(got) == 302 and [r.held_out for r in got if r.doc_id is None] == [False, False]
