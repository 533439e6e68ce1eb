"""Hierarchical density clustering against a plain top-down version over all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import density


def plain_hdbscan(x, m, samples, alpha=1.0, epsilon=0.0):
    """Labels (-1 noise) of the condensed tree, taken apart from the top, edge by edge, heaviest first."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / alpha
    core = np.sort(d, axis=1)[:, samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    tree, root = [], list(range(n))
    for c, a, b in sorted((w[i, j], i, j) for i, j in itertools.combinations(range(n), 2)):
        if root[a] != root[b]:
            tree.append((c, a, b))
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
    clusters = {0: {"birth": 0.0, "up": None, "mass": 0.0, "below": []}}
    left, owner = {0: set(range(n))}, {}
    edges = list(tree)

    def side(start, alive):
        seen, todo = {start}, [start]
        while todo:
            now = todo.pop()
            for _, a, b in alive:
                for p, q in ((a, b), (b, a)):
                    if p == now and q not in seen:
                        seen.add(q)
                        todo.append(q)
        return seen

    for c, a, b in sorted(tree, reverse=True):
        edges.remove((c, a, b))
        name = next((k for k, rows in left.items() if a in rows), None)
        if name is None:
            continue
        one, two = side(a, edges), side(b, edges)
        parts = [p & left[name] for p in (one, two)]
        big = [p for p in parts if len(p) >= m]
        info = clusters[name]
        if len(big) == 2:
            for p in big:
                new = len(clusters)
                clusters[new] = {"birth": 1 / c, "up": name, "mass": 0.0, "below": []}
                info["below"].append(new)
                info["mass"] += len(p) * (1 / c - info["birth"])
                left[new] = p
            del left[name]
        else:
            for p in parts:
                if len(p) < m:
                    info["mass"] += len(p) * (1 / c - info["birth"])
                    owner |= dict.fromkeys(p, name)
            if big:
                left[name] = big[0]
            else:
                del left[name]
    chosen, best = set(), {}
    for k in sorted(clusters, reverse=True):
        below = sum(best[c] for c in clusters[k]["below"])
        if k and clusters[k]["mass"] >= below:
            best[k] = clusters[k]["mass"]
            inside = {k}
            for c in sorted(clusters):
                if clusters[c]["up"] in inside:
                    inside.add(c)
            chosen = (chosen - inside) | {k}
        else:
            best[k] = below
    if epsilon:
        goal = set()
        for k in chosen:
            while 1 / clusters[k]["birth"] < epsilon and clusters[k]["up"]:
                k = clusters[k]["up"]
            goal.add(k)
        chosen = goal

    def label(k):
        found = -1
        while k is not None:
            found = k if k in chosen else found
            k = clusters[k]["up"]
        return found

    return [label(owner[i]) if i in owner else -1 for i in range(n)]


def numbered(labels):
    names = {}
    return [-1 if v == -1 else names.setdefault(v, len(names)) for v in labels]


def blobs(seed, n=70, dims=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-4, 4, (rng.integers(2, 6), dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, rng.choice([0.15, 0.4, 0.8], n)[:, None], (n, dims))
    x[: n // 8] = rng.uniform(-6, 6, (n // 8, dims))
    return x


def table(spark, x):
    return spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("seed,m,samples,epsilon,block,local", [(1, 5, 5, 0.0, 1024, 1 << 20), (2, 4, 3, 0.0, 20, 30), (3, 8, 4, 0.6, 33, 1 << 20), (4, 3, 2, 0.3, 1024, 0)])
def test_hdbscan(spark, seed, m, samples, epsilon, block, local):
    x = blobs(seed)
    got = density.hdbscan_cluster(table(spark, x), "id", "v", epsilon, m, samples, block_rows=block, local_edges=local).orderBy("id").collect()
    want = numbered(plain_hdbscan(x, m, samples, epsilon=epsilon))
    assert [r["Cluster"] for r in got] == want
    assert len(set(want)) > 2


def test_core_distances_and_tree(spark):
    x = blobs(9, 70)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = {r["id"]: r["core"] for r in density.core_distances(table(spark, x), "id", "v", 4, block_rows=16).collect()}
    assert np.allclose([core[1000 + i] for i in range(70)], np.sort(d, axis=1)[:, 3])
    i, j, w = density.dense_forest(np.where(np.eye(70, dtype=bool), np.inf, d))
    for local in (0, 40, 1 << 20):
        tree = density.spanning_tree(density.block_forests(table(spark, x), "id", "v", block_rows=16), local).collect()
        assert len(tree) == 69 and np.isclose(sum(r["w"] for r in tree), w.sum())
    parts = density.dense_forest(np.array([[np.inf, 1, np.inf], [1, np.inf, np.inf], [np.inf] * 3]))
    assert [p.tolist() for p in parts] == [[0], [1], [1.0]]


def test_density_edges(spark):
    one = spark.createDataFrame([("a", [1.0])], "id string, v array<double>")
    assert density.hdbscan_cluster(one, "id", "v").first()["Cluster"] == 0
    assert density.hdbscan_cluster(one.limit(0), "id", "v").count() == 0
    few = spark.createDataFrame([(c, [float(i)]) for i, c in enumerate("abc")], "id string, v array<double>")
    assert {r["Cluster"] for r in density.hdbscan_cluster(few, "id", "v").collect()} == {-1}
    copies = spark.createDataFrame([(f"{k}{i}", [float(5 * k)]) for k in range(2) for i in range(6)] + [("x", [2.4])], "id string, v array<double>")
    got = {r["id"]: r["Cluster"] for r in density.hdbscan_cluster(copies, "id", "v", 0.0, 4).collect()}
    assert {got[f"0{i}"] for i in range(6)} == {0} and {got[f"1{i}"] for i in range(6)} == {1} and got["x"] in (-1, 0, 1)
    with pytest.raises(ValueError):
        density.hdbscan_cluster(few, "id", "v", min_size=1)


def test_forest_of_two_blocks_breaks_ties_by_ids_and_holds_one_matrix():
    import tracemalloc

    rng = np.random.default_rng(6)
    for n, m in ((9, 14), (600, 700)):
        w = np.full((n + m, n + m), np.inf)
        w[:n, n:] = rng.integers(1, 5, (n, m))
        w[n:, :n] = w[:n, n:].T
        rank = rng.permutation(n + m)
        d = np.ascontiguousarray(w[:n, n:])
        tracemalloc.start()
        a, b, c = density._grown(rank, lambda i: (slice(n, n + m), d[i]) if i < n else (slice(0, n), d[:, i - n]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1 << 20
        edges = sorted((w[i, j], *sorted((int(rank[i]), int(rank[j])))) for i in range(n) for j in range(n, n + m))
        root, want = list(range(n + m)), []
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
        for e, i, j in edges if n < 100 else []:
            if find(i) != find(j):
                root[find(i)] = find(j)
                want.append((e, i, j))
        got = sorted(zip(c.tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
        assert got == sorted(want) if want else len(got) == n + m - 1
