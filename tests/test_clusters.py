"""Greedy and agglomerative clusters against one step at a time."""

import numpy as np
import pytest

from brindle.operators import cluster
from brindle.operators.distance import block_distances
from brindle.operators.graph import connected_components
from brindle.sources.tables import settle


def greedy(near):
    """Labels of a 0/1 matrix of neighbours: the row with most free neighbours takes them, the first on ties; the rest in order."""
    n = len(near)
    free, labels, label = np.ones(n, dtype=bool), [-1] * n, 0
    while free.any():
        counts = [int((near[i] & free).sum()) if free[i] else -1 for i in range(n)]
        best = int(np.argmax(counts))
        for m in [best, *np.flatnonzero(near[best] & free)]:
            labels[m], free[m] = label, False
        label += 1
    return labels


def table(spark, x):
    return spark.createDataFrame([(f"r{i:04d}", v.tolist(), i) for i, v in enumerate(x)], "id string, v array<double>, Cluster int").repartition(3)


def labels(df):
    return [r["Cluster"] for r in df.orderBy("id").collect()]


def points(seed, n):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 1, (n, 2)) ** 1.5


@pytest.mark.parametrize("seed,threshold", [(1, 0.1), (2, 0.25)])
def test_butina(spark, seed, threshold):
    x = points(seed, 150)
    d = block_distances(x, x, "euclidean")
    near = (d <= threshold) & ~np.eye(len(x), dtype=bool)
    assert labels(cluster.butina_cluster(table(spark, x), "id", "v", threshold)) == greedy(near)


def test_butina_without_links(spark):
    x = np.arange(6.0)[:, None] * 10
    assert labels(cluster.butina_cluster(table(spark, x), "id", "v", 1.0)) == [0, 1, 2, 3, 4, 5]
    assert cluster.butina_cluster(table(spark, x).limit(0), "id", "v", 1.0).count() == 0


@pytest.mark.parametrize("linkage,threshold", [("average", 0.15), ("complete", 0.2)])
def test_linkage_in_rounds_and_dense(spark, linkage, threshold):
    x = points(5, 160)
    label = cluster.linkage_labels(block_distances(x, x, "euclidean"), threshold, linkage)
    want = np.unique(label, return_inverse=True)[1].tolist()
    for dense_rows in (0, 20, 1000):
        assert labels(cluster.agglomerative_cluster(table(spark, x), "id", "v", threshold, linkage, dense_rows=dense_rows)) == want
    assert 10 < len(set(want)) < 100


@pytest.mark.parametrize("whole_edges", [0, 30, 1 << 15])
def test_components_of_small_graphs_are_one_tasks_work(spark, whole_edges):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500, 500), (7, 7), (None, 3)]
    part = {x: x for p in pairs if None not in p for x in p}
    for a, b in pairs:
        if a is not None and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {k: low if v == high else v for k, v in part.items()}
    for kind, cast in (("long", int), ("string", lambda i: f"é{i:03d}")):
        df = spark.createDataFrame([(None if a is None else cast(a), cast(b)) for a, b in pairs], f"a {kind}, b {kind}")
        got = connected_components(df, settle, whole_edges=whole_edges).collect()
        assert {r["node"]: r["component"] for r in got} == {cast(k): cast(v) for k, v in part.items()} and len(got) == len(part)
    assert connected_components(df.limit(0), settle, whole_edges=whole_edges).count() == 0


@pytest.mark.parametrize("batch_edges", [1, 400])
def test_butina_in_batches(spark, batch_edges):
    """The steps of one task end where a row that it does not hold may come first."""
    x = points(2, 120)
    x[:20] = np.round(x[:20], 1)
    near = (block_distances(x, x, "euclidean") <= 0.25) & ~np.eye(len(x), dtype=bool)
    assert labels(cluster.butina_cluster(table(spark, x), "id", "v", 0.25, batch_edges=batch_edges)) == greedy(near)


@pytest.mark.parametrize("linkage,threshold", [("average", 0.15), ("complete", 0.2)])
def test_linkage_in_rounds_over_blocks(spark, linkage, threshold):
    """Rounds look at clusters block by block; no pair of rows is kept."""
    x = points(5, 160)
    want = np.unique(cluster.linkage_labels(block_distances(x, x, "euclidean"), threshold, linkage), return_inverse=True)[1].tolist()
    assert labels(cluster.agglomerative_cluster(table(spark, x), "id", "v", threshold, linkage, dense_rows=0, block_rows=40)) == want


def test_affinity_products_are_those_of_all_pairs():
    import pyarrow as pa

    x = np.random.default_rng(4).normal(size=(700, 3))
    d = block_distances(x, x, "euclidean")
    w = np.where(d <= 1.1, np.maximum(1e-9, 1 - d), 0.0) * (1 - np.eye(len(x)))
    v = np.arange(len(x)) / len(x)
    got, cut = np.zeros(len(x)), [slice(0, 600), slice(600, 700)]
    for a, b in ((0, 0), (0, 1), (1, 1)):
        row = {"a": [a], "b": [b], "va": [x[cut[a]].tobytes()], "vb": [x[cut[b]].tobytes()], "xa": [v[cut[a]].tobytes()], "xb": [v[cut[b]].tobytes()]}
        for batch in cluster._affinity_products(1.1, "euclidean", 3)(iter([pa.RecordBatch.from_pydict(row)])):
            for r in batch.to_pylist():
                got[cut[r["block"]]] += np.frombuffer(r["y"])
    assert np.allclose(got, w @ v, rtol=0, atol=1e-12)
