"""Quality rules run as a short-circuit cascade.

Each rule rejects or passes a document.  On a sample the operator measures what every
feature costs (nanoseconds a document) and which rules reject each document.  The
rule with the most rejections per cost comes first; then the one with the most
rejections among the documents that are left, per cost of the features that are not
computed yet; and so on.  A document stops at its first rejection.  A verdict is the
conjunction of all rules, so the order changes cost and never the result.  ``judge``
returns five measures of every document, so those are computed for rejected ones too.

Defined cases: a null or empty text has no words and fails ``min_words``;
repeated rows are judged one by one; an empty table gives an empty result;
whole texts are read, whatever their length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import bound_batches, table
from wattline.llm.textkit import Words, _LUT, buffers, rolling, slices, window_ok

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 30
    max_dup_line_percent: int = 30
    #: Fewer duplicate lines than this never reject: short documents may repeat one.
    min_dup_lines: int = 3
    min_mean_word: float = 2.0
    max_mean_word: float = 20.0
    max_upper_percent: int = 60
    min_letter_percent: int = 50


#: Documents of the sample, about; each task times those that it reads.
SAMPLE_ROWS = 4000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: ASCII letters, and the first byte of any longer code point.
_LETTER = _UPPER | _LOWER
_LETTER[0xC2:0xF5] = True


@dataclass(frozen=True)
class Rule:
    """``rejects(features, limits)`` is true where a document fails; ``needs`` names the features."""

    needs: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray], Limits], np.ndarray]


RULES: dict[str, Rule] = {
    "min_words": Rule(("n_words",), lambda f, x: f["n_words"] < x.min_words),
    "repeated_windows": Rule(("n_words", "n_repeat_words"), lambda f, x: 100 * f["n_repeat_words"] > x.max_repeat_percent * f["n_words"]),
    "symbols": Rule(("n_words", "n_symbols"), lambda f, x: 100 * f["n_symbols"] > x.max_symbols_per_100_words * f["n_words"]),
    "mean_word": Rule(("n_words", "word_chars"), lambda f, x: (f["word_chars"] < x.min_mean_word * f["n_words"]) | (f["word_chars"] > x.max_mean_word * f["n_words"])),
    "duplicate_lines": Rule(("n_lines", "n_dup_lines"), lambda f, x: (f["n_dup_lines"] >= x.min_dup_lines) & (100 * f["n_dup_lines"] > x.max_dup_line_percent * f["n_lines"])),
    "upper_case": Rule(("n_upper", "n_lower"), lambda f, x: 100 * f["n_upper"] > x.max_upper_percent * (f["n_upper"] + f["n_lower"])),
    "letters": Rule(("n_letters", "word_chars"), lambda f, x: 100 * f["n_letters"] < x.min_letter_percent * f["word_chars"]),
}

#: Rules that define ``base_failed``.
BASE_RULES = ("min_words", "repeated_windows")


def repeat_words(h: np.ndarray, doc: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text, the words inside k-word windows that occur twice or more in it."""
    n = int(doc[-1])
    windows = rolling(h, k)
    ok = np.flatnonzero(window_ok(doc, k))
    which = np.repeat(np.arange(len(doc) - 1), np.diff(doc))[ok]
    key = windows[ok] ^ (which.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key, kind="stable")
    key, same = key[order], np.zeros(len(order), bool)
    if len(key) > 1:
        equal = key[1:] == key[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    mark = np.zeros(n + 1, np.int32)
    at = ok[order[same]]
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + k, n), -1)
    return counts(np.cumsum(mark)[:n] > 0, doc)


def counts(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flag in each range off[i]:off[i+1]."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Features:
    """Features of consecutive texts, computed when first asked for."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.held = data, off, {}
        self._words = None

    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.data, self.off)
        return self._words

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = getattr(self, "_" + name)()
        return self.held[name]

    def _n_words(self):
        return np.diff(self.words().doc)

    def _word_chars(self):
        return counts(~_LUT[self.data] & ((self.data & 0xC0) != 0x80), self.off)

    def _n_symbols(self):
        return counts(_SYMBOL[self.data], self.off)

    def _n_upper(self):
        return counts(_UPPER[self.data], self.off)

    def _n_lower(self):
        return counts(_LOWER[self.data], self.off)

    def _n_letters(self):
        return counts(_LETTER[self.data], self.off)

    def _n_lines(self):
        self["n_dup_lines"]
        return self.held["n_lines"]

    def _n_dup_lines(self):
        whole, at = self.data.tobytes(), self.off.tolist()
        lines = [[x for x in whole[a:b].split(b"\n") if x.strip()] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.held["n_lines"] = np.array([len(x) for x in lines], np.int64)
        return np.array([len(x) - len(set(x)) for x in lines], np.int64)

    def _n_repeat_words(self):
        w = self.words()
        return repeat_words(w.hashes(), w.doc)

    def subset(self, alive: np.ndarray) -> Features:
        """The same for the texts where ``alive``; what is known already is taken over."""
        length = np.diff(self.off)
        got = Features(self.data[np.repeat(alive, length)], np.concatenate([[0], np.cumsum(length[alive])]))
        got.held = {k: v[alive] for k, v in self.held.items()}
        return got


def cascade(features: Features, order: list[str], limits: Limits) -> np.ndarray:
    """True where every rule passes.  A rule sees only what the rules before it let through."""
    n = len(features.off) - 1
    alive = np.arange(n)
    for name in order:
        if not len(alive):
            break
        bad = RULES[name].rejects({k: features[k] for k in RULES[name].needs}, limits)
        if bad.any():
            alive = alive[~bad]
            features = features.subset(~bad)
    kept = np.zeros(n, bool)
    kept[alive] = True
    return kept


FEATURES = tuple(dict.fromkeys(f for rule in RULES.values() for f in rule.needs))


@dataclass(frozen=True)
class Costs:
    """Nanoseconds a document of each feature, and how many sampled documents each set of rules rejects."""

    feature: dict[str, float]
    rejected: dict[frozenset[str], int]


def sample_costs(docs: DataFrame, text_col: str, limits: Limits, rows: int = SAMPLE_ROWS) -> Costs:
    """Costs and selectivity on about ``rows`` documents, drawn from all partitions and measured where they lie.

    Only a line a feature and a line a set of rejecting rules leave a task.
    """

    def measure(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            own, n = Features(data, off), len(off) - 1
            own.words()
            name, ns = [], []
            for f in FEATURES:
                began = time.perf_counter_ns()
                own[f]
                name.append(f)
                ns.append(time.perf_counter_ns() - began)
            bits = np.zeros(n, np.int64)
            for k, rule in enumerate(RULES.values()):
                bits |= rule.rejects({f: own[f] for f in rule.needs}, limits).astype(np.int64) << k
            sets, many = np.unique(bits, return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(name + [None] * len(sets), pa.string()), "rules": pa.array([0] * len(name) + sets.tolist(), pa.int64()), "ns": pa.array(ns + [0] * len(sets), pa.int64()), "n": pa.array([n] * len(name) + many.tolist(), pa.int64())})

    total = docs.count()
    if not total:
        return Costs({}, {})
    picked = docs.where(F.rand(11) < rows / total).select(text_col)
    found = picked.mapInArrow(measure, "feature string, rules long, ns long, n long").groupBy("feature", "rules").agg(F.sum("ns").alias("ns"), F.sum("n").alias("n")).collect()
    names = list(RULES)
    return Costs({r.feature: r.ns / r.n for r in found if r.feature is not None}, {frozenset(x for k, x in enumerate(names) if r.rules >> k & 1): r.n for r in found if r.feature is None})


def cascade_order(costs: Costs, names: list[str]) -> list[str]:
    """Greedily by rejections per cost among what earlier rules leave; a feature is paid for once."""
    left, known, order = dict(costs.rejected), set(), []
    while len(order) < len(names):

        def worth(x: str):
            price = sum(costs.feature.get(f, 0.0) for f in RULES[x].needs if f not in known)
            return -(sum(n for rules, n in left.items() if x in rules) + 1e-6) / max(1.0, price), x

        best = min((x for x in names if x not in order), key=worth)
        order.append(best)
        known.update(RULES[best].needs)
        left = {rules: n for rules, n in left.items() if best not in rules}
    return order


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _out_schema(docs: DataFrame, keep: tuple[str, ...], more: str):
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return ", ".join([*fields, more])


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns, the measures, base_failed and kept for every row."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate((*keep, text_col))])
    order = cascade_order(sample_costs(docs, text_col, limits), list(RULES))
    schema = _out_schema(docs, keep, ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean")
    out = _arrow(schema)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(len(keep)))
            for i, j in slices(off):
                f = Features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                cols = [f[m] for m in MEASURES]
                base = np.logical_or.reduce([RULES[r].rejects(f, limits) for r in BASE_RULES])
                kept = cascade(f, order, limits)
                rest = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c, pa.int64()) for c in cols], pa.array(base), pa.array(kept)], schema=out)

    return chosen.mapInArrow(run, schema)


def passing(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that every rule passes, columns as given; features are computed only as far as the cascade goes."""
    bound_batches(docs.sparkSession)
    order = cascade_order(sample_costs(docs, text_col, limits), list(RULES))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(at))
            for i, j in slices(off):
                kept = cascade(Features(data[off[i] : off[j]], off[i : j + 1] - off[i]), order, limits)
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
