"""MinHash near-duplicate classes.

Each document's distinct word shingles are reduced to many universal-hash minima
(multiply-shift on 64-bit fingerprints).  Equal shingle sets collapse first, by
fingerprints aggregated map-side.  Representatives meet in band buckets:

1. every member is paired with its bucket's smallest member (a star, never all
   pairs); pairs that pass the signature estimate are confirmed on full sets;
2. links become components by alternating large-star and small-star;
3. documents in buckets that still hold several components go through an exact
   prefix filter: those of different components that share one of their rarest
   shingles are paired and confirmed, which completes the links.  The larger of
   two looks for smaller ones in bands of size; only those are filed whose place
   of the shingle leaves room for a partner of at least their size.

The bands miss a pair at the threshold with probability under ``MISS``; the
signature estimate drops such a pair only ``sigmas`` (five) standard deviations below
it, and never with ``sigmas=None``.  Nothing is capped or sampled, and no link,
signature or set reaches the driver.  Texts are shuffled once, into a table bucketed
by id; the sets of wanted ids are made from it in place.

Defined cases: null texts and texts without words have no set and link with
nothing; a text with fewer words than a shingle is one shingle; rows with a null
id are linked with nothing and have a null component; repeated rows are exact
copies; an empty table gives an empty result; whole texts are read.
"""

from __future__ import annotations

import contextlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, bound_batches, freed_shuffles, shuffle_parts, table
from wattline.llm.components import components
from wattline.llm.textkit import Words, buffers, lower_ascii, mix, rolling, slices, window_ok

MISS = 1e-6
SIGMAS = 5
#: Growth of set sizes from one band of the prefix filter to the next.
BAND = 1.05
#: Text that a bucket of the table of texts holds about, and buckets at most.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 1 << 15


class Plan:
    """Bands and rows for a threshold."""

    def __init__(self, shingle: int, percent: int, sigmas: float | None = SIGMAS):
        self.shingle, self.percent = shingle, percent
        t = percent / 100
        self.rows = 5 if percent >= 85 else 4 if percent >= 75 else 3
        self.bands = math.ceil(math.log(MISS) / math.log(1 - t**self.rows))
        self.hashes = self.rows * self.bands
        self.least = 0.0 if sigmas is None else t - sigmas * math.sqrt(t * (1 - t) / self.hashes)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle fingerprints in order of text, offsets of each text's set)."""
    words = Words(lower_ascii(data), off)
    h, doc = words.hashes(), words.doc
    n = np.diff(doc)
    which = np.repeat(np.arange(len(n)), n)
    win = rolling(h, k)
    ok = np.flatnonzero(window_ok(doc, k))
    key, own = [win[ok]], [which[ok]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            x = h[doc[short]].copy()
            for j in range(1, m):
                x = mix(x, 1000 + m) + h[doc[short] + j]
            key.append(mix(x, 1000 + m))
            own.append(short)
    key, own = np.concatenate(key), np.concatenate(own)
    order = np.argsort(key ^ mix(own.astype(np.uint64), 77), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    first = np.sort(order[~same])
    key, own = key[first], own[first]
    order = np.argsort(own, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))]).astype(np.int64)


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64), 4242) | np.uint64(1)


def minima(key: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(texts with a set, n) minima as 32-bit values; ``at`` are the starts of non-empty sets."""
    out = np.empty((len(at), n), np.uint32)
    for j, a in enumerate(multipliers(n)):
        out[:, j] = np.minimum.reduceat(key * a, at) >> np.uint64(32)
    return out


SIGNED = "n long, f1 long, f2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """id, set size, set fingerprint, band keys and 16-bit sketch of every row."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in slices(off):
                key, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], plan.shingle)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys = np.zeros((len(full), plan.bands), np.uint64)
                low = np.zeros((len(full), plan.hashes), np.uint16)
                if len(full):
                    f1[full], f2[full] = np.add.reduceat(mix(key, 11), at[full]), np.add.reduceat(mix(key, 12), at[full])
                    got = minima(key, at[full], plan.hashes)
                    low = got.astype(np.uint16)
                    by_band = got.reshape(len(full), plan.bands, plan.rows).astype(np.uint64)
                    keys = np.broadcast_to(np.arange(plan.bands, dtype=np.uint64), keys.shape).copy()
                    for r in range(plan.rows):
                        keys = mix(keys ^ by_band[:, :, r], r)
                ends = np.zeros(j - i + 1, np.int32)
                ends[1:] = np.cumsum(n > 0) * plan.bands
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                sketch, k = [None] * (j - i), low.tobytes()
                for r, d in enumerate(full.tolist()):
                    sketch[d] = k[2 * plan.hashes * r : 2 * plan.hashes * (r + 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands, pa.array(sketch, pa.binary())], names=["id", "n", "f1", "f2", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, {SIGNED}")


def set_bytes(docs: DataFrame, plan: Plan) -> DataFrame:
    """(id, sorted set as little-endian 64-bit values)."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in slices(off):
                key, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], plan.shingle)
                rows = [np.sort(key[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def likely(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose signatures don't rule the threshold out."""
    side = reps.select("id", "sketch")
    met = pairs.join(side.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(side.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, plan.hashes) for c in (2, 3))
                keep = (x == y).mean(axis=1) >= plan.least
                yield batch.select([0, 1]).filter(pa.array(keep))

    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full sets."""
    met = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "items": "sb"}), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= plan.percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def prefixes(docs: DataFrame, text: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """(id, n, item, left): the rarest shingles of each of ``docs`` (id, n) of which any pair at the threshold shares one.

    With o = ceil(t * n), two sets that share o items share one among the first
    n - o + 1 of each in a common order; the order is by number of holders.  Items
    of one holder count towards the length and are never shared, so they are left out.
    ``left`` counts the items from this one on: no pair shares more than the smaller
    ``left`` at the first item that it shares.
    """

    def items(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.int64(batch.column(0)[i].as_py()), len(got))), pa.array(got)], names=["id", "item"])

    held = scratch.put(set_bytes(text.join(docs.hint("merge"), "id", "left_semi"), plan).dropDuplicates(["id"]), "prefix-sets")
    rows = held.mapInArrow(items, "id long, item long")
    df = scratch.put(rows.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "prefix-df")
    known = rows.join(df, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("held"))
    room = docs.join(known, "id").withColumn("room", F.col("n") - F.ceil(F.col("n") * plan.percent / F.lit(100)) + 1 - (F.col("n") - F.size("held")))
    own = F.col("n") - F.size("held")
    cut = room.where("room > 0").select("id", "n", own.alias("own"), F.posexplode(F.slice("held", 1, F.col("room").cast("int"))).alias("k", "e"))
    return scratch.put(cut.select("id", "n", F.col("e.item").alias("item"), (F.col("n") - F.col("own") - F.col("k")).alias("left")), "prefixes")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sigmas: float | None = SIGMAS) -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    plan, scratch = Plan(shingle, percent, sigmas), Scratch(spark, "neardup")
    with bucketed_texts(docs, scratch, id_col, text_col) as text:
        return _classes(docs, text, plan, scratch, id_col, text_col)


@contextlib.contextmanager
def bucketed_texts(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str):
    """(id, text) as a table bucketed by id that joins on ids read in place; it is gone afterwards."""
    spark, name = docs.sparkSession, f"wattline_{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(max(shuffle_parts(spark), math.ceil(size / BUCKET_BYTES)), MOST_BUCKETS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    with freed_shuffles(spark):
        rows.repartition(buckets, "id").write.bucketBy(buckets, "id").option("path", f"{scratch.root}/texts").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop("texts")


def across_components(head: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix item at places that leave room for the threshold.

    Two sets of sizes n >= m share at most the smaller ``left`` of a common item, and need
    p * (n + m) / (100 + p).  So the smaller one needs left >= 2 * p * m / (100 + p) itself, and
    the larger one meets only sizes m from p * n / 100 to left * (100 + p) / p - n.  Bands of
    size make that an equal join; rows of an item's largest component never meet each other.
    """
    p = plan.percent
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    parts = head.groupBy("item", "c").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("item").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("item", "main")
    rest = head.join(mixed, "item").select("item", "id", "n", "left", "c", (F.col("c") == F.col("main")).alias("in_main"))
    small = rest.where(F.col("left") * (100 + p) >= 2 * p * F.col("n"))
    small = small.select("item", band(F.col("n")).alias("band"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"), F.col("c").alias("cy"), F.col("in_main").alias("my"))
    least, most = F.ceil(F.col("n") * p / F.lit(100)), F.least(F.col("n"), F.floor(F.col("left") * (100 + p) / F.lit(p)) - F.col("n"))
    large = rest.withColumn("least", least).withColumn("most", most).where((F.col("least") <= F.col("most")) & (F.col("least") > 0))
    large = large.select("item", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"), F.col("c").alias("cx"), F.col("in_main").alias("mx"), "least", "most")
    ordered = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    room = F.col("ny").between(F.col("least"), F.col("most")) & (F.col("ly") * (100 + p) >= p * (F.col("nx") + F.col("ny")))
    meet = lambda x, y: x.join(y, ["item", "band"]).where(ordered & room & (F.col("cx") != F.col("cy"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return meet(large.where("NOT mx"), small).unionByName(meet(large.where("mx"), small.where("NOT my"))).distinct()


def _classes(docs: DataFrame, text: DataFrame, plan: Plan, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    percent = plan.percent
    signed = scratch.put(signatures(docs, plan, id_col, text_col), "signed")
    classes = scratch.put(signed.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.put(signed.where("n > 0").join(classes.select("f1", "f2", "n", F.col("rep").alias("id")), ["f1", "f2", "n", "id"], "left_semi").dropDuplicates(["id"]), "reps")

    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    entries = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high")).where("low.id != high").select("key", "low")
    members = scratch.put(entries.join(buckets, "key"), "members")
    stars = members.where((F.col("id") != F.col("low.id")) & close(F.col("n"), F.col("low.n"))).select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct()
    first = scratch.put(likely(stars, reps, plan), "pairs-1")
    def verify(pairs, label):
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = scratch.put(set_bytes(text.join(wanted.hint("merge"), "id", "left_semi"), plan).dropDuplicates(["id"]), f"sets-{label}")
        links = scratch.put(confirmed(pairs, sets, plan), f"links-{label}")
        scratch.drop(f"sets-{label}")
        return links

    links = verify(first, "1")
    found = components(links, scratch, "cc-1")

    tagged = scratch.put(members.select("key", "id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c")), "tagged")
    parts = tagged.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    scratch.drop("members")
    open_ = scratch.put(tagged.join(mixed, "key", "left_semi").select("id", "n", "c").distinct(), "open")
    head = prefixes(open_.select("id", "n"), text, plan, scratch).join(open_.select("id", "c"), "id")
    head = scratch.put(head, "heads")
    across = across_components(head, plan).join(first, ["a", "b"], "left_anti")
    second = scratch.put(likely(across, reps, plan), "pairs-2")
    if not second.isEmpty():
        more = verify(second, "2")
        found = components(links.unionByName(more), scratch, "cc-2")
    owner = scratch.put(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component")), "owner")
    out = signed.select("id", "n", "f1", "f2").join(owner, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class (and of each id), and all with a null id."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(id_col)
    rows = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return rows.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
