"""Clusterings of a table by a vector column or of an edge table: all label rows by an id, -1 for noise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.distance import TILE_ROWS, _block_rows, _exact, _limit, _meet, _tiles, _vectors, block_distances, pairwise
from brindle.operators.graph import connected_components
from brindle.operators.relational import row_index
from brindle.sources.tables import discard, settle

#: So many clusters that are left, of so many rows, are merged as one task's matrix by average and complete linkage.
DENSE_ROWS = 1_000
DENSE_POINTS = 32_768
#: Rows of clusters whose linkages with a block's clusters are held at once.
LINKED_ROWS = 256
#: Row numbers whose neighbour lists are one row's.
NODE_BLOCK = 8192
#: Neighbours, of all rows together, that one task holds to take greedy steps.
BATCH_EDGES = 1 << 22


def label_values(df: DataFrame, column: str, name: str = "Cluster") -> DataFrame:
    """Dense 0-based labels of the sorted distinct values; null is -1. Distinct values are numbered by range partition."""
    names = row_index(df.select(F.col(column).alias("_named")).where("_named IS NOT NULL").distinct(), "_named", name="_number")
    out = df.join(names, F.col(column) == F.col("_named"), "left").withColumn("_number", F.coalesce("_number", F.lit(-1)).cast("int"))
    return out.drop("_named", name).withColumnRenamed("_number", name)


def number_components(df: DataFrame, id_col: str, components: DataFrame, name: str = "Cluster") -> DataFrame:
    """df with dense labels of components (node, component), in the order of their least node; rows without a node are their own."""
    rooted = df.join(components, F.col(id_col) == F.col("node"), "left").withColumn("_root", F.coalesce("component", F.col(id_col))).drop("node", "component")
    return label_values(rooted, "_root", name).drop("_root")


def component_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, metric: str = "euclidean", edges: DataFrame | None = None) -> DataFrame:
    """Connected components of the graph of pairs with distance <= threshold, numbered by first row."""
    edges = edges if edges is not None else pairwise(df, id_col, vector, metric, threshold)
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), settle)
    return number_components(df, id_col, found)


def dbscan_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, min_samples: int = 5, metric: str = "euclidean", edges: DataFrame | None = None) -> DataFrame:
    """Rows with min_samples rows (itself included) within threshold are cores; linked cores are a cluster; others join
    the lowest cluster among neighbouring cores, or are noise."""
    edges = settle(edges if edges is not None else pairwise(df, id_col, vector, metric, threshold))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count("*").alias("n"))
    alone = df.select(F.col(id_col).alias("src")).join(degree, "src", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select(F.col("src").alias("core"))
    cores = settle(alone)
    linked = both.join(cores, F.col("src") == F.col("core"), "left_semi").join(cores, F.col("dst") == F.col("core"), "left_semi")
    loops = cores.select(F.col("core").alias("a"), F.col("core").alias("b"))
    found = connected_components(linked.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(loops), settle)
    numbered = label_values(found, "component", "_l").select("node", "_l")
    border = both.join(numbered, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("_b")).agg(F.min("_l").alias("_near"))
    out = df.join(numbered, F.col(id_col) == F.col("node"), "left").join(border, F.col(id_col) == F.col("_b"), "left")
    return out.withColumn("Cluster", F.coalesce("_l", "_near", F.lit(-1)).cast("int")).drop("node", "_l", "_b", "_near")


def _placed(df: DataFrame, id_col: str, vector: str | None = None) -> DataFrame:
    """(_id, _node, and _v, the vector): the rows of df numbered in the order of their unique ids."""
    more = [F.col(vector).alias("_v")] if vector else []
    return settle(row_index(df.select(F.col(id_col).alias("_id"), *more), "_id", name="_node"))


def _adjacency(edges: DataFrame) -> DataFrame:
    """(a, block, near, n) of edges (src, dst) between row numbers: the neighbours of a within a block of NODE_BLOCK numbers, as
    places there; no list is longer than that, whatever the degree."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    block = F.floor(F.col("b") / NODE_BLOCK).cast("long")
    return both.groupBy("a", block.alias("block")).agg(F.collect_list((F.col("b") % NODE_BLOCK).cast("int")).alias("near"), F.count("*").alias("n"))


def _greedy_steps(t: pa.Table, least: int, first: int) -> pa.Table:
    """(node, centre, c): the steps of rows t (a, block, near), lists of free neighbours of some rows, in order, as long as a row comes
    before any that has least neighbours and the number first."""
    lists = t.column("near").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    a, b = np.repeat(t.column("a").to_numpy(), sizes), lists.flatten().to_numpy() + np.repeat(t.column("block").to_numpy(), sizes) * NODE_BLOCK
    order = np.argsort(a, kind="stable")
    own, starts, counts = np.unique(a[order], return_index=True, return_counts=True)
    names, members = np.unique(np.r_[own, b[order]], return_inverse=True)
    at, members = members[: len(own)], members[len(own) :]
    row = np.full(len(names), -1)
    row[at] = np.arange(len(own))
    # of each node, the rows that have it as a neighbour
    holders = np.repeat(np.arange(len(own)), counts)[np.argsort(members, kind="stable")]
    ends = np.r_[0, np.cumsum(np.bincount(members, minlength=len(names)))]
    starts, free, counts = np.r_[starts, len(b)], np.ones(len(names), dtype=bool), counts.astype(np.int64)
    node, centre, c = [], [], []
    while len(own):
        i = int(np.argmax(counts))  # the first of the greatest
        k = int(counts[i])
        if k <= 0 or k < least or (k == least and own[i] >= first):
            break
        near = members[starts[i] : starts[i + 1]]
        taken = np.r_[at[i], near[free[near]]]
        free[taken] = False
        held = np.concatenate([holders[ends[m] : ends[m + 1]] for m in taken.tolist()])
        np.subtract.at(counts, held, 1)
        gone = row[taken]
        counts[gone[gone >= 0]] = -(1 << 40)
        node.append(names[taken])
        centre.append(np.full(len(taken), own[i]))
        c.append(np.full(len(taken), k))
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.table({"node": whole(node), "centre": whole(centre), "c": whole(c)})


def _greedy_until(least: int, first: int):
    return lambda t: _greedy_steps(t, least, first)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, block, near, n) without the neighbours whose places are set in gone, a bitmap of the block, or null."""
    for t in batches:
        lists, gone = t.column("near"), t.column("gone").to_pylist()
        sizes = np.diff(lists.offsets.to_numpy())
        places, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        bits = {g: np.frombuffer(g, dtype=np.uint8) for g in set(gone) if g is not None}
        kinds = {g: k for k, g in enumerate(bits, 1)}
        masks = np.stack([np.zeros(NODE_BLOCK // 8, dtype=np.uint8), *bits.values()])
        kind = np.array([kinds.get(g, 0) for g in gone], dtype=np.int64)[row]
        keep = masks[kind, places >> 3] >> (places & 7).astype(np.uint8) & 1 == 0
        n = np.bincount(row[keep], minlength=len(sizes)).astype(np.int64)
        left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(places[keep].astype(np.int32)))
        out = pa.RecordBatch.from_arrays([t.column("a"), t.column("block"), left, pa.array(n)], names=["a", "block", "near", "n"])
        yield out.filter(pa.array(n > 0))


def _bitmap(t: pa.Table) -> pa.Table:
    """(block, gone): the places of the nodes of one block as a bitmap."""
    bits = np.zeros(NODE_BLOCK, dtype=np.uint8)
    bits[t.column("node").to_numpy() % NODE_BLOCK] = 1
    return pa.table({"block": t.column("block").slice(0, 1), "gone": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def butina_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, metric: str = "euclidean", edges: DataFrame | None = None, batch_edges: int = BATCH_EDGES) -> DataFrame:
    """Greedy neighbourhood clustering: again and again the row with most unassigned neighbours (the first on ties) takes them;
    rows left alone are clusters in order.

    Rounds take many of these steps at once. Counts only fall, so the rows with most neighbours, as many as have batch_edges
    neighbours together (one row at least), go through their steps in one task while each comes before all other rows even with the
    counts that those had; then all lists are rid of the rows that were taken. The order of the steps is that of their counts.
    """
    places = _placed(df, id_col, vector)
    if edges is None:
        edges = pairwise(places, "_node", "_v", metric, threshold).select("src", "dst")
    else:
        name = lambda c: places.select(F.col("_id").alias(c), F.col("_node").alias(f"_{c}"))
        edges = edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    now, taken = settle(_adjacency(edges)), []
    while True:
        counts = settle(now.groupBy("a").agg(F.sum("n").alias("c")))
        levels = sorted(((r["c"], r["k"], r["first"]) for r in counts.groupBy("c").agg(F.count("*").alias("k"), F.min("a").alias("first")).collect()), reverse=True)
        if not levels:
            break
        room, chosen, bound = batch_edges, None, (0, 0)
        for level, (c, k, first) in enumerate(levels):
            if c * k > room:
                bound = (c, first)
                if level == 0:  # the first rows of the level
                    cut = counts.where(F.col("c") == c).orderBy("a").offset(max(1, room // c) - 1).limit(1).first()["a"]
                    chosen, bound = (F.col("c") == c) & (F.col("a") <= cut), (c, cut + 1)
                else:
                    chosen = F.col("c") > c
                break
            room -= c * k
        some = now.join(counts.where(chosen).select("a") if chosen is not None else counts.select("a"), "a", "left_semi").select("a", "block", "near")
        steps = settle(some.groupBy(F.lit("all")).applyInArrow(_greedy_until(*bound), "node long, centre long, c long"))
        taken.append(steps)
        if chosen is None:
            break
        gone = steps.select("node", F.floor(F.col("node") / NODE_BLOCK).cast("long").alias("block")).groupBy("block").applyInArrow(_bitmap, "block long, gone binary")
        left = now.join(steps.select("node"), F.col("a") == F.col("node"), "left_anti").join(gone, "block", "left").select("a", "block", "near", "n", "gone")
        before, now = now, settle(left.mapInArrow(_without, "a long, block long, near array<int>, n long"))
        for used in (before, counts):
            discard(used)
    every = places.select(F.col("_node").alias("node"), F.col("_node").alias("centre"), F.lit(0).cast("long").alias("c"))
    if taken:
        every = every.join(reduce(DataFrame.unionByName, taken).select("node"), "node", "left_anti").unionByName(reduce(DataFrame.unionByName, taken))
    every = settle(every)
    names = row_index(every.select("centre", "c").distinct(), F.desc("c"), F.col("centre"), name="_l")
    labels = every.join(names.select("centre", "_l"), "centre").join(places.select("_id", F.col("_node").alias("node")), "node").select("_id", F.col("_l").cast("int").alias("Cluster"))
    return df.drop("Cluster").join(labels, F.col(id_col) == F.col("_id")).drop("_id")


def linkage_labels(d: np.ndarray, threshold: float, linkage: str, size: np.ndarray | None = None) -> np.ndarray:
    """Merges the closest two clusters, by average or complete linkage, while they are within threshold: each row's first row of its cluster.

    d has the distances of rows, or the linkages of clusters of the sizes given."""
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(len(d)) if size is None else size.astype(np.float64), np.arange(len(d))
    while len(d) > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]) if linkage == "average" else np.maximum(d[i], d[j])
        d[i], d[:, i] = row, row
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


def _linkages(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray, metric: str, linkage: str):
    """(first cluster, linkages) of slices of the clusters of a with all clusters of b. ca and cb, the rows' clusters, ascend.

    A slice has whole clusters with LINKED_ROWS rows or little more, or one that is larger; so many rows are held against b at once."""
    starts = lambda c: np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    rows, columns = np.r_[starts(ca), len(ca)], starts(cb)
    add = np.add if linkage == "average" else np.maximum
    sizes = np.diff(np.r_[columns, len(cb)])
    lo = 0
    while lo < len(rows) - 1:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + LINKED_ROWS, "right")) - 1)
        found = None
        for r in range(rows[lo], rows[hi], LINKED_ROWS):
            d = block_distances(a[r : min(r + LINKED_ROWS, rows[hi])], b, metric)
            d = d if len(columns) == len(cb) else add.reduceat(d, columns, axis=1)
            d = add.reduceat(d, rows[lo:hi] - rows[lo], axis=0) if hi > lo + 1 else add.reduce(d, axis=0, keepdims=True)
            found = d if found is None else add(found, d)
        if linkage == "average":
            found = found / (np.diff(rows[lo : hi + 1])[:, None] * sizes[None, :])
        yield lo, np.where(np.isnan(found), np.inf, found)
        lo = hi


def _nearest_clusters(rows: DataFrame, threshold: float, linkage: str, metric: str, block_rows: int | None) -> DataFrame:
    """(c, d, to) of rows (node, root, _v): for each cluster with one within threshold its nearest, the first on ties.

    The rows of a cluster are in one block, so two blocks have all distances between their clusters, and only each one's nearest leaves a task.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c, d, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            own = left.column(2)[0] == left.column(3)[0]
            one, two = left.sort_by("g"), right.sort_by("g2")
            ca, cb = one.column("g").to_numpy(), two.column("g2").to_numpy()
            names, others = np.unique(ca), np.unique(cb)
            least, best = np.full(len(others), np.inf), np.zeros(len(others), dtype=np.int64)
            for lo, m in _linkages(_vectors(one), ca, _vectors(two), cb, metric, linkage):
                mine = names[lo : lo + len(m)]
                if own:
                    m[np.arange(len(m)), lo + np.arange(len(m))] = np.inf
                j = m.argmin(axis=1)  # clusters ascend, so the first of equals is the one to take
                low = m[np.arange(len(m)), j]
                c.append(mine[low <= threshold])
                d.append(low[low <= threshold])
                to.append(others[j[low <= threshold]])
                if not own:
                    i = m.argmin(axis=0)
                    low = m[i, np.arange(m.shape[1])]
                    better = low < least
                    least[better], best[better] = low[better], mine[i[better]]
            c.append(others[least <= threshold])
            d.append(least[least <= threshold])
            to.append(best[least <= threshold])
        return pa.table({"c": np.concatenate(c), "d": np.concatenate(d), "to": np.concatenate(to)})

    met = _meet(rows, None, "node", "_v", "node", block_rows, "root", whole=True)
    return met.applyInArrow(run, "c long, d double, to long").where("d < double('infinity')").groupBy("c").agg(F.min(F.struct("d", "to")).alias("m")).select("c", "m.*")


def agglomerative_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, linkage: str = "average", metric: str = "euclidean", dense_rows: int = DENSE_ROWS, block_rows: int | None = None) -> DataFrame:
    """Clusters merged by average, complete or single linkage while within threshold, numbered by first row.

    Single linkage is the components of the pairs within threshold. For the others, a round finds every cluster's nearest one, block by
    block from the vectors, and merges every two that are each other's nearest, ties by number: no merge brings another cluster nearer,
    so the merges are those of one at a time. For the same reason a cluster with none within threshold is finished and is not looked at
    again. When at most dense_rows clusters are left, of no more than DENSE_POINTS rows, one task's matrix finishes them.
    """
    if linkage == "single":
        return component_cluster(df, id_col, vector, threshold, metric)
    if linkage not in ("average", "complete"):
        raise ValueError(f"no linkage {linkage!r}")
    places = _placed(df, id_col, vector)
    rows, done = settle(places.select(F.col("_node").alias("node"), F.col("_node").alias("root"), "_v")), []

    def dense(t: pa.Table) -> pa.Table:
        t = t.sort_by("root")
        names, at, size = np.unique(t.column("root").to_numpy(), return_inverse=True, return_counts=True)
        v = _vectors(t.select(["node", "_v"]))
        d = np.concatenate([m for _, m in _linkages(v, at, v, at, metric, linkage)])
        return pa.table({"node": t.column("node"), "root": names[linkage_labels(d, threshold, linkage, size)][at]})

    while True:
        n, clusters = rows.agg(F.count("*"), F.count_distinct("root")).first()
        if clusters <= dense_rows and n <= DENSE_POINTS:
            if n:
                done.append(rows.groupBy(F.lit("all")).applyInArrow(dense, "node long, root long"))
            break
        near = settle(_nearest_clusters(rows, threshold, linkage, metric, block_rows))
        back = near.select(F.col("c").alias("to"), F.col("to").alias("c"))
        both = near.where("c < to").join(back, ["c", "to"]).select(F.col("c").alias("root_to"), F.col("to").alias("root"))
        done.append(settle(rows.join(near, F.col("root") == F.col("c"), "left_anti").select("node", "root")))
        moved = rows.join(near, F.col("root") == F.col("c"), "left_semi").join(both, "root", "left").select("node", F.coalesce("root_to", "root").alias("root"), "_v")
        before, rows = rows, settle(moved)
        for used in (before, near):
            discard(used)
    found = reduce(DataFrame.unionByName, done) if done else rows.select("node", "root")
    named = places.select("_id", "_node").join(found.withColumnRenamed("node", "_node"), "_node", "left").select("_id", F.coalesce("root", "_node").alias("_root"))
    return label_values(df.drop("Cluster").join(named, F.col(id_col) == F.col("_id")).drop("_id"), "_root", "Cluster").drop("_root")


def _packed(t: pa.Table) -> pa.Table:
    """(block, v): the vectors of one block as bytes, in the order of their numbers."""
    t = t.sort_by("_node")
    return pa.table({"block": t.column("block").slice(0, 1), "v": pa.array([_vectors(t.select(["_node", "_v"])).tobytes()], pa.large_binary()).cast(pa.binary())})


def _affinity_products(threshold: float, metric: str, width: int):
    """A step over rows (a, b, va, vb, xa, xb) of pairs of blocks: (block, y), the products of the affinity with x, made anew from the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p, q, *parts = (batch.column(c)[r].as_py() for c in ("a", "b", "va", "vb", "xa", "xb"))
                a, b, xa, xb = (np.frombuffer(x) for x in parts)
                a, b = a.reshape(-1, width), b.reshape(-1, width)
                ya, yb = np.zeros(len(a)), np.zeros(len(b))
                for lo, near, slack in _tiles(a, b, metric):
                    w = np.sqrt(np.maximum(near, 0.0)) if metric == "euclidean" else near.copy()
                    np.subtract(1.0, w, out=w)
                    np.maximum(w, 1e-9, out=w)
                    w[~(near <= _limit(threshold, metric, slack))] = 0.0
                    if slack:  # what is near the limit is decided exactly
                        i, j = np.nonzero(np.abs(near - _limit(threshold, metric, 0.0)) <= 2 * slack)
                        d = _exact(a[lo : lo + TILE_ROWS], b, near, i, j, metric)
                        w[i, j] = np.where(d <= threshold, np.maximum(1e-9, 1 - d), 0.0)
                    if p == q:
                        w[np.arange(len(w)), lo + np.arange(len(w))] = 0.0
                    else:
                        yb += w.T @ xa[lo : lo + TILE_ROWS]
                    ya[lo : lo + TILE_ROWS] = w @ xb
                found = [(p, ya.tobytes())] + ([] if p == q else [(q, yb.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["block", "y"])

    return run


def spectral_cluster(df: DataFrame, id_col: str, vector: str, n_clusters: int = 2, threshold: float = 0.3, metric: str = "euclidean", seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Power iteration clustering of the affinity 1 - d over pairs with d <= threshold; rows without a neighbour are -1.

    As Spark's own, from a random start by a keyed hash and with its rule to stop, but no pair is kept: a step makes the affinities of
    two blocks anew from their vectors, as a task's tiles, and only sums a row leave it.
    """
    places = _placed(df, id_col, vector).select("_id", "_node", F.col("_v"))
    first = places.agg(F.count("*"), F.max(F.size("_v"))).first()
    if not first[0]:
        return df.withColumn("Cluster", F.lit(-1))
    size = _block_rows(first[0], None)
    n, width = -(-first[0] // size), first[1]
    blocks = settle(places.select("_node", "_v", F.floor(F.col("_node") / size).cast("long").alias("block")).groupBy("block").applyInArrow(_packed, "block long, v binary"))
    left = blocks.select(F.col("block").alias("a"), F.col("v").alias("va"), F.explode(F.sequence("block", F.lit(n - 1).cast("long"))).alias("b"))
    met = settle(left.join(blocks.select(F.col("block").alias("b"), F.col("v").alias("vb")), "b").repartition(n * (n + 1) // 2))
    product = _affinity_products(threshold, metric, width)

    def times(x: DataFrame) -> DataFrame:
        side = lambda c: x.select(F.col("block").alias(c), F.col("x").alias(f"x{c}"))
        return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb", "xa", "xb").mapInArrow(product, "block long, y binary")

    def summed(t: pa.Table) -> np.ndarray:
        return np.sum([np.frombuffer(y) for y in t.column("y").to_pylist()], axis=0)

    def begun(t: pa.Table) -> pa.Table:
        block, degree = t.column("block")[0].as_py(), summed(t)
        h = np.random.default_rng([seed, block]).standard_normal(len(degree))
        return _state(block, degree, np.where(degree > 0, h, 0.0), 0.0)

    def moved(state: pa.Table, t: pa.Table) -> pa.Table:
        degree = np.frombuffer(state.column("degree")[0].as_py())
        y = np.divide(summed(t), degree, out=np.zeros(len(degree)), where=degree > 0)
        return _state(state.column("block")[0].as_py(), degree, y, 0.0)

    def scaled(norm: float):
        def run(state: pa.Table, old: pa.Table) -> pa.Table:
            x = np.frombuffer(state.column("x")[0].as_py()) / norm
            was = np.frombuffer(old.column("x")[0].as_py())
            return _state(state.column("block")[0].as_py(), np.frombuffer(state.column("degree")[0].as_py()), x, float(np.abs(x - was).sum()))

        return run

    schema = "block long, degree binary, x binary, total double, linked long, off double"
    meet = lambda one, two: one.groupBy("block").cogroup(two.groupBy("block"))
    ones = blocks.select("block", F.col("v")).groupBy("block").applyInArrow(lambda t: pa.table({"block": t.column("block"), "x": pa.array([np.ones(len(v) // (8 * width)).tobytes() for v in t.column("v").to_pylist()], pa.binary())}), "block long, x binary")
    state = settle(times(settle(ones)).groupBy("block").applyInArrow(begun, schema))
    norm, linked = state.agg(F.sum("total"), F.sum("linked")).first()
    if not linked:
        return df.withColumn("Cluster", F.lit(-1))
    state = settle(meet(state, state).applyInArrow(scaled(norm), schema))
    least, before = max(1e-5 / linked, 1e-8), float("inf")
    for _ in range(max_iter):
        raw = settle(meet(state, times(state)).applyInArrow(moved, schema))
        old, state = state, settle(meet(raw, state).applyInArrow(scaled(raw.agg(F.sum("total")).first()[0]), schema))
        off = state.agg(F.sum("off")).first()[0]
        for used in (raw, old):
            discard(used)
        if abs(off - before) <= least:
            break
        before = off

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                degree, x = (np.frombuffer(batch.column(c)[r].as_py()) for c in ("degree", "x"))
                on = np.flatnonzero(degree > 0)
                # of the size of 1, as the rule by which k-means stops is an absolute one
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("block")[r].as_py() * size + on), pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32)), pa.array(x[on] * linked))], names=["_node", "_x"])

    rows = settle(state.mapInArrow(unpacked, "_node long, _x array<double>"))
    found = places.join(kmeans_cluster(rows, "_x", n_clusters, seed).select("_node", F.col("Cluster").alias("_c")), "_node").select("_id", "_c")
    return df.drop("Cluster").join(found, F.col(id_col) == F.col("_id"), "left").withColumn("Cluster", F.coalesce("_c", F.lit(-1))).drop("_id", "_c")


def _state(block: int, degree: np.ndarray, x: np.ndarray, off: float) -> pa.Table:
    """One row of a block of a power iteration."""
    return pa.table({"block": pa.array([block], pa.int64()), "degree": pa.array([degree.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "total": [float(np.abs(x).sum())], "linked": pa.array([int((degree > 0).sum())], pa.int64()), "off": [off]})


def kmeans_cluster(df: DataFrame, vector: str, n_clusters: int = 3, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=n_clusters, seed=seed, featuresCol="_v", predictionCol="Cluster").fit(rows)
    return model.transform(rows).drop("_v")


def optics_cluster(df: DataFrame, id_col: str, vector: str, threshold: float = 0.3, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """The density extraction at one distance, which is dbscan_cluster at that distance."""
    return dbscan_cluster(df, id_col, vector, threshold, min_samples, metric)
