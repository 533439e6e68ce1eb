"""Graph rules and batches."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import graphs, tables

SCHEMA = "id long, x array<array<float>>, src array<int>, dst array<int>, e array<array<float>>, y double"


def graph(i, n, edges, y=0.5):
    return (i, [[float(i), float(k)] for k in range(n)], [a for a, _ in edges], [b for _, b in edges], [[1.0 * a] for a, _ in edges], y)


def test_batches_are_disjoint_unions(spark):
    rows = [graph(7, 2, [(0, 1)]), graph(1, 3, [(0, 1), (2, 0)]), graph(4, 1, []), graph(9, 2, [(1, 0), (1, 1)])]
    got = graphs.graph_batches(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", 3, "x", "src", "dst", "e", "y").orderBy("batch").collect()
    assert [r["ids"] for r in got] == [[1, 4, 7], [9]]
    first, second = got
    assert first["x"] == [[1.0, 0.0], [1.0, 1.0], [1.0, 2.0], [4.0, 0.0], [7.0, 0.0], [7.0, 1.0]]
    assert (first["src"], first["dst"], first["e"]) == ([0, 2, 4], [1, 0, 5], [[0.0], [2.0], [0.0]])
    assert (first["graph"], first["ptr"], first["y"]) == ([0, 0, 0, 1, 2, 2], [0, 3, 4, 6], [0.5, 0.5, 0.5])
    assert (second["src"], second["dst"], second["ptr"]) == ([1, 1], [0, 1], [0, 2])
    both = graphs.undirected(spark.createDataFrame(rows[1:2], SCHEMA), edge_attr="e").first()
    assert (both["src"], both["dst"], both["e"]) == ([0, 2, 1, 0], [1, 0, 0, 2], [[0.0], [2.0], [0.0], [2.0]])
    with pytest.raises(ValueError):
        graphs.graph_batches(spark.createDataFrame(rows, SCHEMA), "id", 0)
    assert graphs.graph_batches(spark.createDataFrame([], SCHEMA), "id", 3).count() == 0


def test_rules_reject_what_is_no_graph(spark, tmp_path):
    good = graph(1, 2, [(0, 1)])
    bad = {
        2: ("no node features", (None, [], [], [])), 3: ("node features of unlike lengths", ([[1.0], [1.0, 2.0]], [], [], [])),
        4: ("node features missing or not finite", ([[float("nan")]], [], [], [])), 5: ("no edge index", ([[1.0]], None, [], [])),
        6: ("edge index of unlike lengths", ([[1.0]], [0], [], [[1.0]])), 7: ("edge to a node that is not there", ([[1.0]], [0], [1], [[1.0]])),
        8: ("edge features are not one an edge", ([[1.0]], [0], [0], [])), 9: ("no node features", ([], [], [], [])),
    }
    df = spark.createDataFrame([good, *[(i, *row, 1.0) for i, (_, row) in bad.items()]], SCHEMA).withColumn("t", F.array("y"))
    meta = tables.write_store(df, f"{tmp_path}/g", "id", "t", graphs.graph_rules(edge_attr="e"))
    assert (meta["records"], meta["rejects"]) == (1, len(bad))
    assert {r["id"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/g/rejects").collect()} == {i: said for i, (said, _) in bad.items()}
    assert graphs.graph_batches(tables.read_store(spark, f"{tmp_path}/g"), "id", 2).first()["ids"] == [1]
