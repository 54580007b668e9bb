"""Language identification by averaged hashed subword embeddings.

A text is the mean embedding of its hashed byte n-grams inside words; a linear
softmax on top is trained by stochastic gradient descent in numpy, on a bounded,
seeded sample of labelled rows: distinct texts of at most ``SAMPLE_BYTES``, at most
``SAMPLE_PER_LANG`` a language and about ``SAMPLE_ROWS`` in all, but up to
``LEAST_PER_LANG`` of each language however many there are.  A temperature and a
rejection threshold are calibrated on a part of the sample that training never sees.

Prediction folds embeddings and softmax weights into one fixed-point logit per
n-gram bucket and language, so a text's sum is exact whatever batch it is in and
whole texts are read.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and
not accepted; so is everything when no labelled row exists.  Rows with a null id
are neither held out nor learned from.  Repeated rows are predicted alike; equal
scores resolve to the first language in order of name; an empty table gives an empty
result; other columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import bound_batches, table
from wattline.llm.textkit import buffers, lower_ascii, slices

BUCKET_BITS = 15
GRAMS = (2, 3, 4)
DIM = 16
SAMPLE_PER_LANG = 1200
SAMPLE_ROWS = 120_000
LEAST_PER_LANG = 50
SAMPLE_BYTES = 1 << 16
EPOCHS = 6
#: Texts whose gradients are applied together.
BATCH = 16
PRECISION = 0.995
_FIXED = 1 << 20

_KIND = np.zeros(256, bool)
_KIND[65:91] = _KIND[97:123] = True
_KIND[0x80:] = True


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in lower case with one mark for all that is no letter, letter mask); bytes over 0x7F count as letters."""
    letter = _KIND[data]
    low = lower_ascii(data)
    if len(data):
        up = np.zeros(len(data), bool)
        up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[up] |= 0x20
    low[~letter] = 0x20
    return low, letter


def gram_buckets(data: np.ndarray, off: np.ndarray):
    """For each n: (first bytes of valid n-grams as a mask, bucket of each position)."""
    low, letter = fold(data)
    n = len(data)
    wide = low.astype(np.uint32)
    gap = (~letter).astype(np.int8)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    code = wide.copy()
    inner = np.zeros(n, np.int8)
    for k in range(2, max(GRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            return
        code = (code[:m] << np.uint32(8)) | wide[k - 1 :]
        if k > 2:
            inner = inner[:m] + gap[k - 2 : k - 2 + m]
        else:
            inner = inner[:m]
        if k in GRAMS:
            ok = (inner == 0) & (left[:m] >= k) & (letter[:m] | letter[k - 1 :])
            h = (code ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            yield ok, (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def gram_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's buckets, in order of text."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    found = [text[: len(ok)][ok] << BUCKET_BITS | b[ok] for ok, b in gram_buckets(data, off)]
    key, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), n


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (languages, buckets + 1) fixed-point logits; the last bucket is 0
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages)."""
        n, docs = len(data), len(off) - 1
        total = np.zeros((docs, len(self.langs)), np.int64)
        count = np.zeros(docs, np.int64)
        full = np.flatnonzero(np.diff(off) > 0)
        if n and len(full):
            # One language after another: memory follows the text, whatever the number of languages.
            grams = [np.where(ok, bucket, 1 << BUCKET_BITS).astype(np.int32) for ok, bucket in gram_buckets(data, off)]
            at = off[full]
            seen = np.zeros(n, np.int64)
            for bucket in grams:
                seen[: len(bucket)] += bucket < 1 << BUCKET_BITS
            count[full] = np.add.reduceat(seen, at)
            for c in range(len(self.langs)):
                seen[:] = 0
                for bucket in grams:
                    seen[: len(bucket)] += self.table[c][bucket]
                total[full, c] = np.add.reduceat(seen, at)
        return total / (_FIXED * np.maximum(count, 1))[:, None] + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(data, off) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Averaged embeddings and softmax by SGD; each step sees a whole text or a random run of its words."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(texts))
    held = order[: max(1, len(order) // 5)] if len(order) > 20 else order[:0]
    fit = order[len(held) :]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    w, bias = rng.normal(0, 0.1, (len(langs), DIM)), np.zeros(len(langs))
    words = [texts[i].split() for i in range(len(texts))]
    weight = len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        turn = rng.permutation(fit)
        for first in range(0, len(turn), BATCH):
            some = turn[first : first + BATCH]
            cut = []
            for i, k in zip(some.tolist(), rng.choice([2, 6, 20, 60], len(some)).tolist(), strict=True):
                start = int(rng.integers(0, max(1, len(words[i]) - k + 1)))
                cut.append(b" ".join(words[i][start : start + k]))
            which, at, n = gram_counts(np.frombuffer(b"".join(cut), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in cut])]))
            if not len(at):
                continue
            head = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            rows = which[head]
            share = n / np.repeat(np.add.reduceat(n, head), np.diff(np.append(head, len(n))))
            x = np.add.reduceat(share[:, None] * emb[at], head)
            z = x @ w.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = p / p.sum(axis=1, keepdims=True)
            truth = y[some[rows]]
            g[np.arange(len(rows)), truth] -= 1
            g *= np.minimum(2.0, weight[truth])[:, None]
            back = (g @ w)[np.repeat(np.arange(len(rows)), np.diff(np.append(head, len(n))))]
            w -= 0.1 * rate * g.T @ x
            bias -= 0.01 * rate * g.sum(axis=0)
            order = np.argsort(at, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], at[order[1:]] != at[order[:-1]]]))
            emb[at[order[new]]] -= rate * np.add.reduceat((share[:, None] * back)[order], new)
    table_ = np.zeros((len(langs), (1 << BUCKET_BITS) + 1), np.int32)
    table_[:, :-1] = np.clip(np.rint(w @ emb.T * _FIXED), -(2**31) + 1, 2**31 - 1)
    model = Model(langs, table_, bias, 1.0, 0.0)
    check = held if len(held) else fit
    if len(check):
        data = np.frombuffer(b"".join(texts[i] for i in check), np.uint8)
        z = model.logits(data, np.concatenate([[0], np.cumsum([len(texts[i]) for i in check])]))
        truth = y[check]

        def loss(t):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return -np.mean(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(axis=1)))

        model.temperature = float(min(np.geomspace(0.25, 10, 60), key=loss))
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        p = s / s.sum(axis=1, keepdims=True)
        right, score = p.argmax(axis=1) == truth, p.max(axis=1)
        by = np.argsort(-score)
        precise = np.flatnonzero(np.cumsum(right[by]) >= PRECISION * np.arange(1, len(by) + 1))
        model.threshold = float(score[by[precise[-1]]]) if len(precise) else 1.0
    return model


def sample(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """The bounded training sample: texts below a hash threshold set for each language by its count of distinct texts."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    lang, text, h = F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")
    counts = rows.select(lang, h).distinct().groupBy("lang").count().collect()
    if not counts:
        return [], []
    most = max(LEAST_PER_LANG, min(SAMPLE_PER_LANG, SAMPLE_ROWS // len(counts)))
    # Room for chance: about four standard deviations above the bound; what is over it goes below, in order of hash.
    scale, aim = 1 << 30, most + 4 * int(most**0.5)
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(scale, scale * aim // r["count"])) for r in counts], "lang string, below long")
    picked = rows.select(lang, text, h).join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(scale)) < F.col("below")).select("lang", "text").distinct().collect()
    held: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (hashlib.md5(r.text.encode()).digest(), r.text)):
        held.setdefault(r.lang, []).append(r.text)
    chosen = sorted((t, x) for x, texts in held.items() for t in texts[:most])
    return [t.encode() for t, _ in chosen], [x for _, x in chosen]


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and accepted."""
    bound_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*fields, "lang_pred string, score double, accepted boolean"])
    out = to_arrow_schema(_parse_datatype_string(schema))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def lettered(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts with a letter: ASCII ones show at once, others are looked at."""
        plain = (_KIND[data] & (data < 0x80)).astype(np.int64)
        wide = (data >= 0x80).astype(np.int64)
        a, b = (np.concatenate([[0], np.cumsum(x)]) for x in (plain, wide))
        sure, maybe = a[off[1:]] > a[off[:-1]], b[off[1:]] > b[off[:-1]]
        for i in np.flatnonzero(~sure & maybe).tolist():
            sure[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
        return sure

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = buffers(batch.column(len(keep)))
            for i, j in slices(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                if m is None:
                    names, score, accepted = ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    best, score = m.predict(part, at)
                    ok = lettered(part, at)
                    names = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
                    score = np.where(ok, score, 0.0)
                    accepted = ok & (score >= m.threshold)
                rest = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], schema=out)

    return docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate((*keep, text_col))]).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    texts, labels = sample(docs, F.coalesce(part != 2, F.lit(False)))
    model = train(texts, labels) if texts else None
    held_out = F.coalesce(part == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), model, keep=("doc_id", "held_out"))
