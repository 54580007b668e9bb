"""Groups of documents that exchange sorted entries with reducers and get answers back.

Documents are dealt into groups by a hash of their id and written once as a table
bucketed by group, so every later round reads a group where it lies: texts are
shuffled once, and then only entries and answers travel.  A group deduplicates what
it sends, so a string that a third of all documents share reaches a reducer once
a group, not once a document: hot keys are pre-aggregated before the shuffle.
Answers are bitmaps or numbers in the order of the entries, which the group derives
again from its documents; nothing is broadcast and nothing reaches the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, freed_shuffles, shuffle_parts
from wattline.llm.textkit import buffers

GROUP_BYTES = 8 << 20
#: Reducers hold about a quarter of a million entries each; there are at least so many.
LEAST_REDUCERS = 48
#: Tasks of a reduce stage; more reducers share tasks.
MOST_TASKS = 1 << 16
#: Groups that share a bucket of the groups' table, and buckets at most.
GROUPS_PER_BUCKET = 4
MOST_BUCKETS = 1 << 15
ENTRIES = "g int, r int, body binary"
ANSWERS = "g int, step int, r int, bits binary"
ENTRY_ARROW = pa.schema([("g", pa.int32()), ("r", pa.int32()), ("body", pa.binary())])
ANSWER_ARROW = pa.schema([("g", pa.int32()), ("step", pa.int32()), ("r", pa.int32()), ("bits", pa.binary())])
#: Null ids come after all others.
NULL_ID = np.iinfo(np.int64).max


class Group:
    """A group's rows in order of (id, text)."""

    def __init__(self, table: pa.Table):
        self.g = table.column("g")[0].as_py() if table.num_rows else -1
        ids = table.column("id").combine_chunks()
        self.null_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        text = table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.cast(pa.large_string()).combine_chunks()
        order = np.argsort(self.id, kind="stable")
        if len(order) > 1 and (np.diff(self.id[order]) == 0).any():
            plain = text.to_pylist()
            order = np.array(sorted(range(len(plain)), key=lambda i: (self.id[i], plain[i] or "")))
        self.id, self.null_id = self.id[order], self.null_id[order]
        self.data, self.off = buffers(text.take(pa.array(order)))


def growth(size: int) -> float:
    """Beyond a terabyte of text groups and reducers grow with the root of the size, so that entries still travel in batches."""
    return max(1.0, (size / (1 << 40)) ** 0.5)


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(documents with their group, number of groups, bytes of text)."""
    size = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    groups = max(4 * shuffle_parts(docs.sparkSession), math.ceil(size / (GROUP_BYTES * growth(size))))
    g = F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).cast("int").alias("g")
    return docs.select(g, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), groups, size


def by_range(keys: np.ndarray, reducers: int) -> np.ndarray:
    """Reducer of each 64-bit key by its high bits (monotone in the key)."""
    return ((keys >> np.uint64(32)) * np.uint64(reducers) >> np.uint64(32)).astype(np.int64)


def stretches(reducer: np.ndarray) -> list[tuple[int, int, int]]:
    """(reducer, begin, end) of each stretch of equal, sorted reducers."""
    names, first = np.unique(reducer, return_index=True)
    return list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(reducer)][: len(names)], strict=True))


def rows_to(g: int, names: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([g] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], schema=ENTRY_ARROW)


def send(g: int, reducer: np.ndarray, parts: list[np.ndarray]) -> pa.Table:
    """One row a reducer: the entries dealt to it (``reducer`` is sorted), each part as a column of bytes, one after another."""
    parted = stretches(reducer)
    return rows_to(g, [k for k, _, _ in parted], [b"".join(p[a:b].tobytes() for p in parts) for _, a, b in parted])


def answer(g: list[int], r: int, step: int, flags: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Bitmaps of consecutive runs of ``flags``, or the numbers of other arrays; one run for each sender."""
    at = np.concatenate([[0], np.cumsum(counts)])
    pack = np.packbits if flags.dtype == bool else np.asarray
    bits = [pack(flags[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    n = len(g)
    return pa.Table.from_arrays([pa.array(g, pa.int32()), pa.array([step] * n, pa.int32()), pa.array([r] * n, pa.int32()), pa.array(bits, pa.binary())], schema=ANSWER_ARROW)


def _bodies(answers: pa.Table, step: int) -> dict[int, bytes]:
    rows = answers.filter(pa.compute.equal(answers.column("step"), step)) if answers.num_rows else answers
    return dict(zip(rows.column("r").to_pylist(), rows.column("bits").to_pylist(), strict=True))


def numbers_of(answers: pa.Table, step: int, reducer: np.ndarray) -> np.ndarray:
    """The 64-bit numbers of a step in the order of the group's entries (sorted by reducer)."""
    got = _bodies(answers, step)
    return np.frombuffer(b"".join(got[k] for k, _, _ in stretches(reducer)), np.uint64)


def flags_of(answers: pa.Table, step: int, reducer: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The bits of a step in the order of the group's entries (sorted by reducer), ``weight`` bits an entry."""
    got = _bodies(answers, step)
    total = np.arange(len(reducer) + 1) if weight is None else np.concatenate([[0], np.cumsum(weight)])
    out = [np.unpackbits(np.frombuffer(got[k], np.uint8), count=int(total[b] - total[a])) for k, a, b in stretches(reducer)]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def reduce_by(entries: DataFrame, work: Callable[[list[int], list[bytes], int], pa.Table], reducers: int) -> DataFrame:
    """Run ``work(senders, bodies, reducer)`` for each reducer; small inputs may be much work, so partitions are not merged by size."""

    def run(key, table):
        bodies = [b.as_py() for b in table.column("body")]
        senders = table.column("g").to_pylist()
        order = sorted(range(len(senders)), key=senders.__getitem__)
        return work([senders[i] for i in order], [bodies[i] for i in order], key[0].as_py())

    return entries.repartition(min(reducers, MOST_TASKS), "r").groupBy("r").applyInArrow(run, ANSWERS)


def with_answers(docs: DataFrame, answers: DataFrame | None, work: Callable[[Group, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work(group, its answers)`` for each group."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if answers is None:
        return docs.groupBy("g").applyInArrow(lambda table: work(Group(table), ANSWER_ARROW.empty_table()), schema)
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(left, right):
        return work(Group(left), right) if left.num_rows else empty

    return docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, schema)


def rounds(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, steps: Sequence[tuple], last, schema: str, bytes_per_entry: float) -> DataFrame:
    """An exchange for each (send, reduce) and a last pass; ``send`` and ``last`` make their workers from the number of reducers.

    Returns a frame that reads the written result; what the rounds needed is deleted.
    """
    spark = docs.sparkSession
    rows, groups, size = dealt(docs, id_col, text_col)
    reducers = max(LEAST_REDUCERS, int(size / bytes_per_entry / growth(size)) >> 18)
    buckets = min(math.ceil(groups / GROUPS_PER_BUCKET), MOST_BUCKETS)
    name = f"wattline_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        rows.repartition(buckets, "g").write.bucketBy(buckets, "g").option("path", f"{scratch.root}/groups").saveAsTable(name)
    try:
        held, got = spark.table(name), None
        for k, (send_, reduce_) in enumerate(steps, 1):
            found = scratch.put(reduce_by(with_answers(held, got, send_(reducers), ENTRIES), reduce_, reducers), f"answers-{k}")
            got = found if got is None else got.unionByName(found)
        out = scratch.put(with_answers(held, got, last(reducers), schema), "result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop("groups")
    for k in range(1, len(steps) + 1):
        scratch.drop(f"answers-{k}")
    return out
