"""Recall and routing of the forest over several cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import ann


def recall(spark, x, every, cell_rows, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % every == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    asked = list(range(0, len(x), every))
    scores = x[asked] @ x.T
    for row, q in zip(scores, asked):
        row[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-row)[:20].tolist()))
    return hit / (20 * len(asked))


def visits(x, asked, cell_rows, monkeypatch):
    """The share of cells that a query goes to."""
    monkeypatch.setattr(ann, "CELL_ROWS", cell_rows)
    routes = ann.Routes(x.shape[1], float((x * x).sum(axis=1).max()))
    codes = routes.codes(x)

    def counted(depth, prefixes, at):
        within = np.isin(codes >> (ann.ROUTE_BITS - at) if at else np.zeros(len(codes), dtype=np.int64), prefixes)
        return dict(zip(*(a.tolist() for a in np.unique(codes[within] >> (ann.ROUTE_BITS - depth), return_counts=True))))

    routes.grow(counted, len(x))
    cells = routes.cells(codes)
    sizes = np.bincount(cells, minlength=len(routes.leaves))
    assert all(-(-s // cell_rows) == p for s, p in zip(sizes.tolist(), routes.parts))
    assert all((c >> (ann.ROUTE_BITS - routes.leaves[i][0])) == routes.leaves[i][1] for c, i in zip(codes.tolist()[:200], cells.tolist()))
    order = np.argsort(-(x[asked] @ x.T), axis=1)[:, 1:21]
    size = np.linalg.norm(x[asked], axis=1) * np.sqrt(routes.top)
    routes.cosine = min(0.999, float(np.quantile(np.einsum("ij,ij->i", x[asked], x[order[:, -1]]) / size, 0.25)))
    routes.lift = min(0.95, float(np.median(np.sqrt(np.maximum(0, 1 - (x[order] ** 2).sum(axis=2) / routes.top)))))
    gone = [set(routes.route(x[q], ann.REACH)) for q in asked]
    assert np.mean([np.isin(cells[o], list(g)).mean() for o, g in zip(order, gone)]) >= 0.9
    return np.mean([len(g) for g in gone]) / sum(p > 0 for p in routes.parts)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(400, 64))
    return centres[rng.integers(0, 400, size=20_000)] + 0.25 * rng.normal(size=(20_000, 64))


def test_recall_of_many_cells(spark, monkeypatch, clustered):
    assert recall(spark, clustered, 100, 2_000, monkeypatch) >= 0.9


def test_recall_without_structure(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(20_000, 64))
    assert recall(spark, x, 200, 4_000, monkeypatch) >= 0.9


def test_near_neighbours_mean_few_cells(monkeypatch, clustered):
    asked = list(range(0, 20_000, 400))
    assert visits(clustered, asked, 500, monkeypatch) < 0.35


def test_hot_prefixes_are_cut_deeper_and_into_parts(monkeypatch):
    rng = np.random.default_rng(0)
    tight = np.ones((6_000, 16)) + 1e-13 * rng.normal(size=(6_000, 16))
    x = np.r_[tight, rng.normal(size=(12_000, 16))]
    assert 0 < visits(x, [0, 7_000, 8_000], 1_000, monkeypatch) <= 1


def test_lengths_that_differ_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0]), (20, [3.0, 2.0, 1.0]), (4, []), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 1, 2), (20, 2, 1)]


def test_the_share_of_candidates_follows_the_data():
    """Clusters need few candidates, at any size of the cell; vectors without structure need more, and recall stays."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 32))
    shares = {}
    for name, x in {"few": centres[rng.integers(0, 50, 2000)], "many": centres[rng.integers(0, 50, 8000)], "none": np.zeros((4000, 32))}.items():
        x = x + rng.normal(size=x.shape) * (0.1 if name != "none" else 1.0)
        forest = ann.Forest(x)
        shares[name] = forest.share(x[:48], 11)
        hits = [len(set(np.argsort(-(x @ q))[:11]) & set(rows)) for q, rows in zip(x[100:150], forest.nearest(x[100:150], 11, shares[name]))]
        assert sum(hits) >= 0.9 * 11 * 50
    assert shares["many"] <= shares["few"] <= 0.2 < shares["none"]


def test_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "x", 1) for i in range(1, 30)]
    for name in ("rank", "score", "query_id", "QUERY_ID"):
        df = spark.createDataFrame(rows, f"`{name}` long, embedding array<double>, hits string, cell int")
        out = ann.search(df, F.col(name) == 3, k=2, id_col=name)
        assert out.columns == ["query_id", "rank", name + "_", "score"]
        assert [tuple(r) for r in out.orderBy("rank").collect()] == [(3, 1, 29, 88.0), (3, 2, 28, 85.0)]
