"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import discard


#: Edges of a graph that one task may hold.
WHOLE_EDGES = 1 << 15


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _whole(t: pa.Table) -> pa.Table:
    """(node, component) of the edges (a, b) of a small graph."""
    kind = t.schema.field("a").type
    ends = [t.column(c).to_numpy() for c in ("a", "b")]
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = np.arange(len(names))
    for i, j in zip(*(x.tolist() for x in np.split(at, 2)), strict=True):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    for i in range(len(root)):  # roots have smaller places than what points to them
        root[i] = root[root[i]]
    return pa.table({"node": pa.array(names, kind), "component": pa.array(names[root], kind)})


def connected_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], max_rounds: int = 60, whole_edges: int = WHOLE_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that can be reached.

    Edges stay distributed; each round shuffles them, and settle() writes its result to a table, so that lineage stays short.
    Rounds grow with the logarithm of the longest path. A graph of at most whole_edges edges, or one that rounds have
    shrunk to that, is one task's work. Self loops count as nodes, nulls are dropped.
    """
    edges = settle(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    kind = edges.schema["a"].dataType.simpleString()
    whole = lambda df: df.groupBy(F.lit("all")).applyInArrow(_whole, f"node {kind}, component {kind}")
    if edges.count() <= whole_edges:
        return whole(edges)
    alone = edges.where("a = b").select("a").distinct()
    now = settle(edges.where("a <> b").distinct())
    state = None
    for _ in range(max_rounds):
        before, now = now, settle(_small_star(_large_star(now)))
        discard(before)
        # sums of two whole 64-bit hashes tell the edges apart, whatever their order
        hashes = [F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(20,0)")) for k in (1, 2)]
        seen = tuple(now.agg(F.count("*"), *hashes).first())
        if seen == state or seen[0] <= whole_edges:
            break
        state = seen
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    if seen[0] <= whole_edges:
        found = whole(now)
    else:
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    lone = alone.join(found, alone["a"] == found["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.unionByName(lone)
