"""Connected components by alternating large-star and small-star.

Edges stay distributed; each half round is two shuffles (a minimum per node with
map-side combine, and a join that Spark may split at hot nodes) and is written to
the shared folder, so a lost executor never costs an earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch

#: Star rounds needed are logarithmic in the longest path; more means a defect.
MAX_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u moves to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end of its edges) and its smaller neighbours move to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.  ``links`` has columns a, b."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.put(edges, f"{label}-0")
    before = _mark(edges)
    for k in range(1, MAX_ROUNDS + 1):
        if not before[0]:
            break
        half = scratch.put(_large_star(edges), f"{label}-{k}-large")
        edges = scratch.put(_small_star(half), f"{label}-{k}")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
