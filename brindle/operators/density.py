"""Density clustering by hierarchy: core distances, minimum spanning trees, condensed cluster trees (HDBSCAN).

All pairs are looked at once, block by block, and only a spanning forest of each pair of blocks is shuffled: together the
forests connect, below any weight, what all pairs connect. The tree of clusters is found from the tree's edges in rounds of joins; only
its merges of whole clusters, at most one for every min_size rows, are put in order in one task, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.operators.cluster import label_values
from brindle.operators.distance import MERGED, TILE_ROWS, _block_rows, _chunks, _exact, _first, _least, _meet, _tiles, _vectors, block_distances
from brindle.operators.graph import connected_components
from brindle.operators.relational import row_index
from brindle.sources.tables import discard, settle

#: Rows of a block whose spanning forest with another block is one task's matrix.
FOREST_ROWS = 4096
#: Edges that one task takes to finish a spanning tree; with more, every component first joins its nearest one, in parallel.
LOCAL_EDGES = 1 << 20
#: Merges of whole clusters, and so clusters, that one task puts in order; beyond, hdbscan_cluster refuses.
LOCAL_MERGES = 5_000_000
#: Distances below count as this in densities, so that copies have a finite one.
LEAST_DISTANCE = 1e-12

KEY = "struct<w:double,a:bigint,b:bigint>"


def core_distances(df: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(id_col, core): the distance of each row to its k-th nearest row, itself the first; of fewer rows to the furthest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            p, q = left.column(2)[0].as_py(), left.column(3)[0].as_py()
            for own, two, other in [(left, right, q)] if p == q else [(left, right, q), (right, left, p)]:
                a, b = _vectors(own), _vectors(two)
                got = min(k, len(b))
                for lo, near, slack in _tiles(a, b, metric):
                    # of its own block, a row's distance to itself is among them
                    i, j = _least(near, _chunks(len(b)), None, got, slack)
                    d = _exact(a[lo : lo + TILE_ROWS], b, near, i, j, metric)
                    least = d[np.lexsort((d, i))][_first(i, got)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * got), pa.array(least))
                    parts.append(pa.table([own.column(0).slice(lo, len(near)), pa.array(np.full(len(near), other // MERGED, np.int32)), lists], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("part", pa.int32()), ("least", pa.list_(pa.float64()))])
    found = _meet(df, None, id_col, vector, id_col, block_rows).applyInArrow(run, f"id {kind.simpleString()}, part int, least array<double>")
    for by in (("id", "part"), ("id",)):  # twice, so that no list grows with the table
        found = found.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k).alias("least"))
    return found.select(F.col("id").alias(id_col), F.element_at("least", -1).alias("core"))


def _grown(rank: np.ndarray, weights: Callable[[int], tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight) of the minimum spanning forest of nodes 0 to n - 1: weights tells a node's weights to a slice of nodes, infinite
    where there is no edge. Edges are pairs of ranks; of equal weights the smaller (a, b), a < b, comes first.

    A tree grows by one node a step (Prim), and beside the weights only a few numbers a node are held. Two edges that lead to one node
    differ in their other end only, so the smaller other end is the smaller edge.
    """
    n = len(rank)
    best, free, near = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)  # best is -inf, free inf, for what is in a tree
    start, at, now = np.argsort(rank), 0, -1
    a, b, c = [], [], []
    for _ in range(n):
        least = free[int(np.argmin(free))]
        if least < np.inf:
            ties = np.flatnonzero(free == least)
            now = int(ties[0]) if len(ties) == 1 else int(ties[np.lexsort((np.maximum(near[ties], rank[ties]), np.minimum(near[ties], rank[ties])))[0]])
            a.append(near[now])
            b.append(rank[now])
            c.append(least)
        else:
            while best[start[at]] == -np.inf:
                at += 1
            now = int(start[at])  # the next tree of the forest
        best[now], free[now] = -np.inf, np.inf
        part, w = weights(now)
        mine, there = rank[now], best[part]
        better = np.flatnonzero((w < there) | ((w == there) & (mine < near[part])))
        there[better] = free[part][better] = w[better]
        near[part][better] = mine
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(c)


def dense_forest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_grown() of a symmetric matrix."""
    return _grown(np.arange(len(w)), lambda i: (slice(0, len(w)), w[i]))


def block_forests(df: DataFrame, id_col: str, vector: str, metric: str = "euclidean", core: str | None = None, alpha: float = 1.0, block_rows: int | None = None) -> DataFrame:
    """(a, b, w), a < b: a minimum spanning forest of each pair of blocks; ids are longs.

    w is the distance over alpha, or with core, a column of core distances, the greatest of it and both core distances. A task
    holds one matrix of its two blocks, at most FOREST_ROWS rows each.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        own = left.column(2)[0] == left.column(3)[0]
        right = left if own else right  # the same rows, maybe in another order
        d = block_distances(_vectors(left), _vectors(right), metric)
        d /= alpha
        x, y = left.column(0).to_numpy(), right.column(0).to_numpy()
        if core:
            np.maximum(d, left.column("g").to_numpy()[:, None], out=d)
            np.maximum(d, right.column("g" if own else "g2").to_numpy()[None, :], out=d)
        if own:
            np.fill_diagonal(d, np.inf)
            ids, n = x, len(x)
            weights = lambda i: (slice(0, n), d[i])
        else:
            ids, n = np.r_[x, y], len(x)
            weights = lambda i: (slice(n, len(ids)), d[i]) if i < n else (slice(0, n), d[:, i - n])
        names, rank = np.unique(ids, return_inverse=True)
        i, j, c = _grown(rank, weights)
        return pa.table({"a": names[np.minimum(i, j)], "b": names[np.maximum(i, j)], "w": c})

    block_rows = block_rows or min(FOREST_ROWS, _block_rows(df.count(), None))
    return _meet(df, None, id_col, vector, id_col, block_rows, core).applyInArrow(run, "a long, b long, w double")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _finished(t: pa.Table) -> pa.Table:
    """The edges of t (ca, cb, a, b, w) that join components, lightest first."""
    t = t.select(["ca", "cb", "a", "b", "w"])
    ca, cb, a, b, w = (t.column(c).to_numpy() for c in t.column_names)
    names = np.unique(np.r_[ca, cb])
    x, y, parent, kept = np.searchsorted(names, ca), np.searchsorted(names, cb), np.arange(len(names)), []
    for k in np.lexsort((b, a, w)).tolist():
        i, j = _find(parent, x[k]), _find(parent, y[k])
        if i != j:
            parent[i] = j
            kept.append(k)
    return pa.table({"a": a[kept], "b": b[kept], "w": w[kept]})


def spanning_tree(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b, w) of a minimum spanning forest of edges (a, b, w) between longs; of equal weights the smaller (a, b) comes first.

    While there are more than local_edges edges, every component takes its lightest edge to another one, all at once, and only
    the lightest edge between two components stays (Boruvka). The rest is one task's work.
    """
    now, out = settle(edges.where("a <> b").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")), []
    while now.count() > local_edges:
        both = now.unionByName(now.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "a", "b", "w"))
        taken = settle(both.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("m")).select("ca", "m.*"))
        out.append(taken.select("a", "b", "w").distinct())
        parts = settle(connected_components(taken.select(F.col("ca").alias("a"), F.col("cb").alias("b")), settle))
        here = now.join(parts.select(F.col("node").alias("ca"), F.col("component").alias("x")), "ca").join(parts.select(F.col("node").alias("cb"), F.col("component").alias("y")), "cb")
        least = here.where("x <> y").groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
        before, now = now, settle(least.select("ca", "cb", "m.a", "m.b", "m.w"))
        discard(before)
    rest = now.groupBy(F.lit("all")).applyInArrow(_finished, "a long, b long, w double")
    for part in out:
        rest = rest.unionByName(part)
    return rest


def joined(tree: DataFrame, min_size: int) -> DataFrame:
    """(node, t): the edge (w, a, b) of a spanning tree at which each node's component, edges added lightest first, reaches min_size nodes.

    In a round, each component that is still smaller finds its lightest edge. If that leads to a component that is large
    enough, it is attached there; two whose lightest edge is the same are merged, in that order, as nothing else can come
    between. Nodes of components that never get so large are left out.
    """
    edges = tree.select(F.struct("w", "a", "b").alias("k"), "a", "b")
    both = settle(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "k").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "k")))
    none = F.lit(None).cast(KEY)
    open_, done = settle(both.select(F.col("x").alias("node")).distinct().select("node", F.col("node").alias("comp"), F.lit(1).cast("long").alias("n"))), []
    while True:
        every = open_.select("node", "comp", "n", none.alias("t"))
        for part in done:
            every = every.unionByName(part.select("node", F.lit(None).cast("long").alias("comp"), F.lit(None).cast("long").alias("n"), "t"))
        ends = every.select(F.col("node").alias("y"), F.col("comp").alias("to"), F.col("n").alias("nto"), F.col("t").isNotNull().alias("large"))
        out = both.join(open_.withColumnRenamed("node", "x"), "x").join(ends, "y").where("large OR to <> comp")
        light = out.groupBy("comp").agg(F.first("n").alias("n"), F.min(F.struct("k", "to", "nto", "large")).alias("m")).select("comp", "n", "m.*")
        light = settle(light)
        twice = light.where("NOT large").groupBy("k").agg(F.count("*").alias("c")).where("c = 2").select("k")
        merged = light.where("NOT large").join(twice, "k").select("comp", F.least("comp", "to").alias("new"), (F.col("n") + F.col("nto")).alias("size"), "k")
        step = light.where("large").select("comp", F.lit(None).cast("long").alias("new"), F.lit(min_size).cast("long").alias("size"), "k").unionByName(merged)
        step = settle(step)
        if step.isEmpty():
            break
        moved = open_.join(step, "comp", "left")
        done.append(settle(moved.where(F.col("size") >= min_size).select("node", F.col("k").alias("t"))))
        left = moved.where(F.col("size").isNull() | (F.col("size") < min_size))
        before, open_ = open_, settle(left.select("node", F.coalesce("new", "comp").alias("comp"), F.coalesce("size", "n").alias("n")))
        for used in (before, light, step):
            discard(used)
    found = tree.sparkSession.createDataFrame([], f"node long, t {KEY}")
    for part in done:
        found = found.unionByName(part)
    return found


def cluster_tree(merges: DataFrame, first_new: int) -> DataFrame:
    """The hierarchy of clusters from merges (x, y, k): rows (cluster, j, up, parent, top, last).

    Of each cluster, at j = 0: its parent and top, the edge at which it becomes part of it, both null for a root; and for each
    j, up, its ancestor 2^j levels up, and last, the top of the one below that. Merged clusters are numbered from first_new. One task.
    """

    def run(t: pa.Table) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        k = t.column("k").combine_chunks()
        w, a, b = (k.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        names = np.unique(np.r_[x, y])
        root, parent = np.arange(len(names)), np.arange(len(names))  # of each set, the cluster that it is
        ids, up, top = names.tolist(), [-1] * len(names), [-1] * len(names)
        left, right = np.searchsorted(names, x), np.searchsorted(names, y)
        for e in np.lexsort((b, a, w)).tolist():
            i, j = _find(parent, left[e]), _find(parent, right[e])
            for c in (root[i], root[j]):
                up[c], top[c] = len(ids), e
            parent[i], root[j] = j, len(ids)
            ids.append(first_new + len(ids) - len(names))
            up.append(-1)
            top.append(-1)
        ids, up, last = np.array(ids), np.array(up), np.array(top)
        rows, jump = [], up
        while True:
            has = np.flatnonzero(jump >= 0)
            kept = np.arange(len(ids)) if not rows else has
            rows.append((kept, np.full(len(kept), len(rows)), jump[kept], last[kept]))
            if not len(has):
                break
            further = np.where(jump >= 0, jump, 0)
            # 2^(j+1) levels up: first jump, then again; the top below that is the second jump's
            last = np.where((jump >= 0) & (jump[further] >= 0), last[further], -1)
            jump = np.where(jump >= 0, jump[further], -1)
        own, level, to, edge = (np.concatenate(c) for c in zip(*rows, strict=True))
        key = lambda e: pa.StructArray.from_arrays([pa.array(np.where(e >= 0, v[np.maximum(e, 0)], 0), mask=e < 0) for v in (w, a, b)], names=["w", "a", "b"], mask=pa.array(e < 0))
        name = lambda c: pa.array(ids[np.maximum(c, 0)], mask=c < 0)
        return pa.table({"cluster": ids[own], "j": pa.array(level, pa.int32()), "up": name(to), "last": key(edge)})

    found = merges.groupBy(F.lit("all")).applyInArrow(run, f"cluster long, j int, up long, last {KEY}")
    return found


def _chosen(t: pa.Table, epsilon: float) -> pa.Table:
    """(cluster, chosen): of the clusters t (cluster, parent, top, n, density) the one chosen at or above each, or null.

    n rows leave a cluster by themselves, with a sum of density (1 / distance). Excess of mass: a cluster is taken rather than those below it if
    its own stability is at least theirs together. Roots are not taken. With epsilon, a cluster that was split off below that distance gives way
    to the nearest one above that was not, or to the last below the root.
    """
    cluster, parent, top, n, density = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "parent", "top", "n", "density"))
    order = np.argsort(cluster)  # clusters that were merged later have larger numbers than what they hold
    cluster, parent, top, n, density = cluster[order], parent[order], top[order], n[order].astype(float), density[order].astype(float)
    has = ~np.isnan(parent.astype(float))
    up = np.where(has, np.searchsorted(cluster, np.where(has, parent, 0).astype(np.int64)), -1)
    birth = np.where(has, 1 / np.maximum(np.where(has, top, 1.0).astype(float), LEAST_DISTANCE), 0.0)
    size, below, stable = n.copy(), np.zeros(len(n)), density - n * birth
    best, taken = np.zeros(len(n)), np.zeros(len(n), dtype=bool)
    for i in range(len(n)):
        taken[i] = has[i] and stable[i] >= below[i]
        best[i] = stable[i] if taken[i] or not has[i] else below[i]
        if has[i]:
            p = up[i]
            size[p] += size[i]
            below[p] += best[i]
            stable[p] += size[i] * (birth[i] - birth[p])
    chosen = np.full(len(n), -1)
    for i in range(len(n) - 1, -1, -1):  # from the roots down: what is below a taken one is its
        above = chosen[up[i]] if has[i] else -1
        chosen[i] = above if above >= 0 else i if taken[i] else -1
    if epsilon:
        goal = chosen.copy()
        for i in np.flatnonzero(chosen == np.arange(len(n))).tolist():
            at = i
            while 1 / birth[at] < epsilon and has[up[at]]:
                at = up[at]
            goal[i] = at
        final = np.full(len(n), -1)
        held = np.zeros(len(n), dtype=bool)
        held[goal[np.flatnonzero(chosen == np.arange(len(n)))]] = True
        for i in range(len(n) - 1, -1, -1):
            above = final[up[i]] if has[i] else -1
            final[i] = above if above >= 0 else i if held[i] else -1
        chosen = final
    return pa.table({"cluster": cluster, "chosen": pa.array(cluster[np.maximum(chosen, 0)], mask=chosen < 0)})


def hdbscan_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, min_size: int = 5, min_samples: int | None = None, alpha: float = 1.0, metric: str = "euclidean", block_rows: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """df with Cluster: clusters of the hierarchy of mutual reachability by excess of mass, numbered by first row, -1 for noise.

    min_size is the least size of a cluster, min_samples (min_size if not given) the rank of the neighbour, a row itself the
    first, that gives core distances; clusters split off below threshold stay together (0: none do). Rows are told apart by
    unique ids. One row is cluster 0, no row none; ties of distances go by the order of ids.
    """
    if min_size < 2:
        raise ValueError("a cluster has two rows at least")
    places = settle(row_index(df.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), "_id", name="_node").withColumn("_node", F.col("_node").cast("long")))
    n = places.count()
    if n <= 1:
        return df.withColumn("Cluster", F.lit(0))
    core = core_distances(places, "_node", "_v", min_samples or min_size, metric, block_rows).withColumn("core", F.col("core") / alpha)
    tree = settle(spanning_tree(block_forests(settle(places.join(core, "_node")), "_node", "_v", metric, "core", alpha, block_rows), local_edges))
    reached = settle(joined(tree, min_size))
    known = lambda end: reached.select(F.col("node").alias(end), F.col("t").alias(f"t{end}"))
    edges = settle(tree.join(known("a"), "a", "left").join(known("b"), "b", "left").withColumn("k", F.struct("w", "a", "b")).withColumn("merge", F.coalesce((F.col("ta") < F.col("k")) & (F.col("tb") < F.col("k")), F.lit(False))))
    loops = reached.select(F.col("node").alias("a"), F.col("node").alias("b"))
    parts = settle(connected_components(edges.where("NOT merge").select("a", "b").unionByName(loops), settle))
    part = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
    merges = settle(edges.where("merge").join(part("a", "x"), "a").join(part("b", "y"), "b").select("x", "y", "k"))
    if merges.count() > LOCAL_MERGES:
        raise ValueError(f"more than {LOCAL_MERGES} clusters; use a larger min_size")
    lifts = settle(cluster_tree(merges, n))
    # every row starts in the leaf cluster of its part and climbs, in powers of two, while it is reached later than that ends
    at = reached.join(parts.select("node", F.col("component").alias("cluster")), "node")
    levels = lifts.agg(F.max("j")).first()[0]
    for j in range(levels if levels is not None else -1, -1, -1):
        step = lifts.where((F.col("j") == j) & F.col("up").isNotNull()).select("cluster", "up", "last")
        at = at.join(step, "cluster", "left").select("node", "t", F.when(F.col("last") < F.col("t"), F.col("up")).otherwise(F.col("cluster")).alias("cluster"))
    at = settle(at)
    own = at.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(1 / F.greatest(F.col("t.w"), F.lit(LEAST_DISTANCE))).alias("density"))
    rows = lifts.where("j = 0").select("cluster", F.col("up").alias("parent"), F.col("last.w").alias("top")).join(own, "cluster", "left").na.fill(0, ["n", "density"])
    chosen = rows.groupBy(F.lit("all")).applyInArrow(lambda t: _chosen(t, threshold), "cluster long, chosen long")
    named = at.join(settle(chosen).where("chosen IS NOT NULL"), "cluster").select("node", "chosen")
    first = named.groupBy("chosen").agg(F.min("node").alias("_first"))
    found = places.select("_id", "_node").join(named.join(first, "chosen").select(F.col("node").alias("_node"), "_first"), "_node", "left").drop("_node")
    out = df.join(found, F.col(id_col) == F.col("_id"), "left").drop("_id")
    return label_values(out, "_first", "Cluster").drop("_first")
