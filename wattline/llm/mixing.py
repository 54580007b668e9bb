"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network routes token capacity from patterns to source quotas; using
a pattern's words again costs more each time (convex cost), so first uses are
exhausted before repeats.  Seeded hash order then turns each pattern's routed
words into documents.

Distributed state is one row per document; the driver holds one number per
pattern and per source.

Defined cases: null text has size 0 and is never routed; a null source is a
source of its own, last in code-point order; repeated rows are separate
documents; an empty table gives an empty result; ties in hash order break by
document id, then size.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, n_words

#: Hash buckets of a pattern's seeded order; running sums are taken per bucket.
BUCKET_HEX = 3


def quotas(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Targets: ``share`` of all sizes by weight; what exceeds cap*size is reshared until nothing does."""
    total = share * sum(sizes)
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def min_cost_flow(supply: dict, quota: dict, max_repeat: int) -> dict:
    """Words routed from each pattern (a tuple of sources) to each of its sources.

    Successive shortest paths with potentials; pattern p has ``max_repeat`` arcs of
    capacity supply[p] and costs 0, 1, 2, ..., so repeats come last.
    """
    nodes = {("s",): 0, ("t",): 1}
    arcs: list[list] = []
    out: list[list[int]] = [[], []]

    def node(key):
        if key not in nodes:
            nodes[key] = len(nodes)
            out.append([])
        return nodes[key]

    def arc(u, v, cap, cost):
        out[u].append(len(arcs))
        arcs.append([v, cap, cost])
        out[v].append(len(arcs))
        arcs.append([u, 0, -cost])

    routes = {}
    for p in sorted(supply, key=str):
        u = node(("p", p))
        for r in range(max_repeat):
            arc(0, u, supply[p], r)
        for s in p:
            if s in quota:
                routes[p, s] = len(arcs)
                arc(u, node(("q", s)), supply[p] * max_repeat, 0)
    for s in sorted(quota, key=str):
        arc(node(("q", s)), 1, quota[s], 0)
    height = [0] * len(nodes)
    while True:
        dist = [None] * len(nodes)
        via = [-1] * len(nodes)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k in out[u]:
                v, cap, cost = arcs[k]
                if cap > 0 and (dist[v] is None or d + cost + height[u] - height[v] < dist[v]):
                    dist[v] = d + cost + height[u] - height[v]
                    via[v] = k
                    heapq.heappush(heap, (dist[v], v))
        if dist[1] is None:
            break
        height = [h + d if d is not None else h for h, d in zip(height, dist, strict=True)]
        amount, v = None, 1
        while v:
            amount = arcs[via[v]][1] if amount is None else min(amount, arcs[via[v]][1])
            v = arcs[via[v] ^ 1][0]
        v = 1
        while v:
            arcs[via[v]][1] -= amount
            arcs[via[v] ^ 1][1] += amount
            v = arcs[via[v] ^ 1][0]
    return {key: arcs[k ^ 1][1] for key, k in routes.items()}


def _ranked(docs: DataFrame, members: Column, size: Column, id_col: str, weight_cycle: Sequence[float], share: float, max_repeat: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with pattern, size, order key, whole and extra uses; plan with one row a pattern)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select(F.col(id_col).alias("id"), _members(members).alias("members"), size.cast("long").alias("size"), _order(id_col, seed).alias("h"))
    base = scratch.put(base.withColumn("bucket", F.substring("h", 1, BUCKET_HEX)), "sizes")
    found = base.groupBy("members").agg(F.sum("size").alias("n")).collect()
    supply = {tuple(r.members): int(r.n or 0) for r in found}
    sources = sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or ""))
    weights = {s: float(weight_cycle[i % len(weight_cycle)]) for i, s in enumerate(sources)}
    sizes = {s: sum(n for p, n in supply.items() if s in p) for s in sources}
    target = dict(zip(sources, quotas([sizes[s] for s in sources], [weights[s] for s in sources], share, max_repeat), strict=True))
    flow = min_cost_flow({p: n for p, n in supply.items() if n}, {s: round(t) for s, t in target.items()}, max_repeat)
    routed = {p: sum(flow.get((p, s), 0) for s in p) for p in supply}

    plan_type = "members array<string>, words long, routed long, plan array<struct<source:string,source_size:long,target:double>>"
    plan = spark.createDataFrame([(list(p), supply[p], routed[p], [(s, sizes[s], float(target[s])) for s in p]) for p in supply], plan_type)
    plan = plan.withColumn("pattern", _pattern("members")).drop("members")
    whole = F.when(F.col("words") > 0, F.floor(F.col("routed") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("routed") - F.col("whole") * F.col("words"))
    base = base.withColumn("pattern", _pattern("members"))
    buckets = base.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).drop("in_bucket").join(plan, "pattern")
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("run", F.sum("size").over(within)).join(buckets, ["pattern", "bucket"])
    middle = 2 * (F.col("before") + F.col("run")) - F.col("size")
    extra = (middle <= 2 * F.col("rest")) & (F.col("size") > 0) & (F.col("rest") > 0)
    return rows.withColumn("extra", extra), plan


def _members(members: Column) -> Column:
    return F.array_sort(F.array_distinct(members))


def _order(id_col: str, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)


def _pattern(members) -> Column:
    return F.to_json(F.struct(F.col(members).alias("m") if isinstance(members, str) else members.alias("m")), {"ignoreNullFields": "false"})


#: Sources weigh 5, 2, 1, repeating, and share 150 % of all sizes; no document is used more than twice.
PRODUCTION = {"weight_cycle": (5, 2, 1), "share": 1.5, "max_repeat": 2, "seed": "mix"}


def mix(docs: DataFrame, members: Column, size: Column, *, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, members, size, copies, taken and plan array<struct<source,source_size,target>>.

    ``members`` is an array<string> column; null entries name the null source.
    Sources are weighted in code-point order, null last, by repeating ``weight_cycle``.
    """
    rows, _ = _ranked(docs, members, size, id_col, **(PRODUCTION | how))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra"), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies).select(F.col("id").alias(id_col), "members", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"), "plan")


def mixed(docs: DataFrame, members: Column, size: Column, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns as given.

    The documents of a pattern's last, partial use are those up to one order key, so
    a row a pattern decides all: texts are not shuffled.
    """
    how = PRODUCTION | how
    rows, plan = _ranked(docs, members, size, id_col, **how)
    key = lambda i, n: F.struct(F.col("h"), F.col(i).alias("id"), F.col(n).alias("size"))
    last = rows.where("extra").groupBy("pattern").agg(F.max(key("id", "size")).alias("last"))
    rule = Scratch(docs.sparkSession, "mix").put(plan.select("pattern", "whole").join(last, "pattern", "left"), "rule")
    if rule.count() <= BROADCAST_PATTERNS:
        rule = F.broadcast(rule)
    given = [F.col(c) for c in docs.columns]
    hidden = docs.select(F.struct(*given).alias("__row"), F.col(id_col).alias("__id"), _pattern(_members(members)).alias("pattern"), size.cast("long").alias("__size"), _order(id_col, how["seed"]).alias("h"))
    met = hidden.join(rule, "pattern")
    extra = F.coalesce(key("__id", "__size") <= F.col("last"), F.lit(False))
    copies = F.when(F.col("__size") > 0, F.col("whole") + F.when(extra, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    return met.select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__use")).select("__row.*")


#: Patterns whose rule is broadcast; with more it is joined.
BROADCAST_PATTERNS = 20_000


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattline.llm.common import table

    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, F.array("source"), n_words(F.col("text")))
    return mixed.select("doc_id", "size", F.col("plan")[0]["source_size"].alias("source_size"), F.col("plan")[0]["target"].alias("target"), "taken", "copies")
