"""Worked examples and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import expr as X
from brindle.functions.checks import select_modalities, validate_modalities
from brindle.operators import bounds, cluster, dedup, distance, features, graph, metrics, relational, split, stats, text, transform
from brindle.plans import activity, evaluation, populations
from brindle.sources import tables


def one(df):
    return df.first()[0]


def test_unit_error(spark):
    df = spark.createDataFrame([("a", 6.0), ("a", 9.0), ("b", 6.0), ("b", 9.1), ("c", 6.0)], "k string, v double")
    assert dict(dedup.unit_errors(df, "k", "v").collect()) == {"a": True, "b": False, "c": False}
    assert one(spark.range(1).select(X.unit_error(F.array(F.lit(1.0), F.lit(10.0)))))


MAD = [("a", 5.0), ("a", 5.1), ("a", 9.9), ("b", 5.0), ("b", 7.0), ("c", 5.0), ("c", 5.0), ("c", 9.0), ("d", 5.0), (None, 4.0)]


def test_mad(spark):
    df = spark.createDataFrame(MAD, "k string, v double")
    want = {"a": 5.05, "b": None, "c": None, "d": 5.0}
    for got in (dedup.mad_values(df, "k", "v"), dedup.mad_rounds(df, "k", "v", 4)):
        assert {k: None if v is None or v != v else round(v, 6) for k, v in got.collect()} == want
    kept = dedup.mad_duplicates(df, "k", "v").collect()
    assert len(kept) == len(MAD) and [r["v"] for r in kept if r["k"] is None] == [None]


@pytest.mark.parametrize(("sides", "want"), [((5.0, 6.5, None), (None, None)), ((5.0, 4.0, None), (5.0, "=")), ((None, 5.0, 5.8), (5.4, "=")), ((None, 6.0, 5.7), (5.85, "=")), ((None, 4.0, 8.0), (None, None)), ((None, 4.0, None), (4.0, ">"))])
def test_reconcile(sides, want):
    got = dedup.reconcile(*sides, 1.0)
    assert got[1] == want[1] and (got[0] is None) == (want[0] is None) and (got[0] is None or abs(got[0] - want[0]) < 1e-9)


def test_censored_rejects_unknown_relations(spark):
    df = spark.createDataFrame([("a", 1.0, "~")], "k string, v double, r string")
    with pytest.raises(Exception, match="unknown relation"):
        dedup.censored_values(df, "k", "v", "r").collect()


def test_bins_and_strata(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "v double")
    assert [r["Bin"] for r in split.bin_data(df, "v", 3).orderBy("v").collect()] == [1, 1, 2, 3, 3]
    s = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.9)], "x string, y int, z double")
    assert [r["Bin"] for r in split.collate_strata(s, ["x", "y", "z"]).orderBy("x").collect()] == ["a:1:1", "b:2:5"]


def test_minimal_split(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(6)], "i int, c int")
    got = split.minimal_split(df, 0.33, "c").groupBy("Set").count().collect()
    assert dict(got) == {"Train": 4, "Test": 2}
    assert split.minimal_split(df.withColumn("c", F.lit(0)), 0.33, "c") is None


def test_temporal_split(spark):
    df = spark.createDataFrame([(t,) for t in range(1, 7)], "t int")
    assert sorted(r["t"] for r in split.temporal_split(df, "t", 0.33).where("Set = 'Test'").collect()) == [4, 5, 6]
    assert split.temporal_split(df, "t", 1.0).where("Set = 'Test'").count() == 6
    assert [r["t"] for r in split.temporal_split(df, "t", 0.0).where("Set = 'Test'").collect()] == [6]
    assert split.temporal_split(df.where("false"), "t", 0.2).count() == 0
    ties = df.unionByName(spark.createDataFrame([(None,), (6,), (6,)], "t int"))
    assert sorted(r["t"] for r in split.temporal_split(ties, "t", 0.2).where("Set = 'Test'").collect()) == [6, 6, 6]


def test_cluster_folds(spark):
    df = spark.range(60).select("id", (F.col("id") % 12).alias("c"), (F.col("id") % 2).alias("s"))
    got = split.cluster_folds(df, 3, "c", "s")
    assert got.groupBy("c").agg(F.count_distinct("Fold").alias("n")).where("n > 1").count() == 0 and got.count() == 60
    with pytest.raises(RuntimeError, match="not balanced"):
        split.cluster_folds(df.withColumn("c", F.when(F.col("id") < 50, 0).otherwise(F.col("id"))), 3, "c")
    rows = [(f"m{i}", [1, 0, 0, 0] if i % 4 == 0 else [0, 1, 0, 0] if i % 4 == 1 else [0, 0, 1, 0] if i % 4 == 2 else [0, 0, 0, 1]) for i in range(40)]
    mols = spark.createDataFrame(rows + rows[:4], "s string, v array<int>")
    for fn in (split.butina_folds, split.component_folds):
        got = fn(mols, 2, "s", "v")
        assert got.count() == 44 and got.groupBy("v").agg(F.count_distinct("Fold").alias("n")).where("n > 1").count() == 0
    got = split.scaffold_folds(mols, 2, "s", F.substring("s", -1, 1), tolerance=0.5)
    assert got.groupBy(F.substring("s", -1, 1)).agg(F.count_distinct("Fold").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("probs", [[0.0, 0.5, 1.0], [0.013, 0.2, 0.99]])
def test_exact_quantiles(spark, probs):
    rng = np.random.default_rng(3)
    data = {"few": rng.normal(size=7), "many": rng.normal(size=30_000), "ties": rng.integers(0, 5, size=25_000).astype(float), "one": np.array([2.5])}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()] + [pd.DataFrame({"k": ["few", "none"], "v": [float("nan")] * 2})]))
    got = {r["k"]: r["q"] for r in relational.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, probs).tolist())
    whole = relational.quantiles(df, "v", probs).orderBy("prob").collect()
    assert [r["quantile"] for r in whole] == pytest.approx(np.quantile(np.concatenate(list(data.values())), probs).tolist())


def test_places_by_range(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1009).alias("o"), F.lit(2).alias("w")).repartition(5)
    got = relational.running_total(df, ["g"], ["o"], "w", "t").collect()
    by = {}
    for r in sorted(got, key=lambda r: r["o"]):
        assert r["t"] == by.get(r["g"], 0)
        by[r["g"]] = by.get(r["g"], 0) + 2
    for n in (0, 1, 499, 1000):
        assert relational.sample_exact(df, "id", n=n).count() == n
    assert split.random_split(df, 0.25, "id").where("Set = 'Test'").count() == 250


def test_mad_rounds_are_those_of_the_values(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(x)) for k in range(40) for x in np.r_[rng.normal(5, 0.2, size=rng.integers(1, 30)), rng.normal(5, 4, size=rng.integers(0, 4))]] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    want = {r["k"]: r["v"] for r in dedup.mad_values(df, "k", "v").collect()}
    got = {r["k"]: r["v"] for r in dedup.mad_rounds(df, "k", "v", 30).collect()}
    assert set(got) == set(want) == set(range(40))
    for k in want:
        values = np.sort([v for q, v in rows if q == k and v is not None])
        assert got[k] == pytest.approx(want[k]) == pytest.approx(dedup.consensus(values, 1.0, 3.5))


def test_pruning_by_the_high_correlations_alone():
    # 1 has two high ones; of 3 and 4, 4's only high one is the same, so the smaller goes
    pairs = [(0, 1, 0.95), (1, 2, 0.92), (0, 2, 0.1), (3, 4, 0.99), (0, 3, 0.89), (0, 4, 0.0)]
    assert transform.prune_correlated(pairs, [0, 1, 2, 3, 4]) == [0, 2, 4]
    assert len(transform.PRESETS) == 3 + 19 and transform.preset("ECFP").clipping is None


def test_side_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.2), ("c", 1.0), ("c", 5.0), (None, 1.0)], "k string, v double")
    got = dedup.duplicate_tables(df, "k", "v")
    assert {n: sorted(tuple(r) for r in t.collect()) for n, t in got.items()} == {"unique": [("a", 1.0)], "agreed": [("b", 1.1, 2)], "failed": [("c", 1.0), ("c", 5.0)]}
    done = spark.createDataFrame([(1, "ok", None), (2, "bad", "x"), (3, None, "y")], "i int, s string, r string")
    kept, others = dedup.outcome_tables(done, "s", "ok", ["i"], "r")
    assert [r["i"] for r in kept.collect()] == [1] and sorted(tuple(r) for r in others.collect()) == [(2, "bad", "x"), (3, "missing", "y")]


def test_norm_bands_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * rng.exponential()).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    whole = {(r["src"], r["dst"]) for r in distance.pairwise(df, "i", "v").where("distance <= 0.2").collect()}
    assert whole == {(r["src"], r["dst"]) for r in distance.pairwise(df, "i", "v", threshold=0.2, block_rows=16).collect()}
    bits = spark.createDataFrame([(i, (rng.random(12) < rng.random()).astype(int).tolist()) for i in range(200)], "i int, v array<int>")
    whole = {(r["src"], r["dst"]) for r in distance.pairwise(bits, "i", "v", "tanimoto").where("distance <= 0.4").collect()}
    assert whole == {(r["src"], r["dst"]) for r in distance.pairwise(bits, "i", "v", "tanimoto", 0.4, block_rows=16).collect()}


def test_splits_conserve_rows(spark):
    df = spark.range(103).select("id", (F.col("id") % 3).alias("s"), (F.col("id") % 10).alias("g"))
    got = split.random_split(df, 0.3, "id")
    assert got.count() == 103 and got.where("Set = 'Test'").count() == 30
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in split.random_split(df.repartition(7), 0.3, "id").collect()}
    for f in (split.random_folds(df, 5, "id"), split.stratified_folds(df, 5, "s", "id"), split.group_folds(df, 5, "g"), split.balanced_group_folds(df, 5, "g", "s")):
        assert f.count() == 103 and f.select("Fold").distinct().count() == 5
    sizes = sorted(r["count"] for r in split.random_folds(df, 5, "id").groupBy("Fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    assert split.group_folds(df, 5, "g").groupBy("g").agg(F.count_distinct("Fold").alias("n")).where("n > 1").count() == 0


def test_fold_views(spark):
    f = split.Folds(spark.range(10).withColumn("Fold", F.col("id") % 5), "Fold", 4)
    assert f.train(0).count() + f.evaluation(0).count() + f.test().count() == 10
    with pytest.raises(ValueError):
        f.evaluation(4)
    assert one(split.fold_balance(spark.createDataFrame([(0,)] * 10 + [(1,)] * 11 + [(2,)] * 9, "Fold int"), "Fold", 0.2).select("balanced"))


HAMMING = [(0, [0.0, 1.0, 0.0], 0), (1, [1.0, 0.0, 1.0], 1), (2, [0.0, 0.0, 1.0], 0)]


def test_k_neighbors(spark):
    df = spark.createDataFrame(HAMMING, "id int, v array<double>, g int")
    got = {r["id"]: r for r in distance.k_neighbors(df, "id", "v", "hamming", nearest=[1, 2]).collect()}
    assert [round(got[i]["Mean"], 6) for i in range(3)] == [0.833333, 0.666667, 0.5]
    assert [round(got[i]["Min"], 6) for i in range(3)] == [0.666667, 0.333333, 0.333333]
    assert all(got[i]["2 Nearest"] == pytest.approx(got[i]["Mean"]) for i in range(3))
    assert distance.k_neighbors(df, "id", "v", "hamming").columns == ["id", "Mean", "Min", "Max"]
    with pytest.raises(Exception, match="k is larger"):
        distance.k_neighbors(df, "id", "v", nearest=[5]).collect()


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "canberra", "braycurtis", "hamming"])
def test_blocks_agree_with_expressions(spark, sf_dir, metric):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(60)
    a = {(r[0], r[1]): r[2] for r in distance.pairwise(e, "vec_id", "embedding", metric, block_rows=16).collect()}
    b = {(r[0], r[1]): r[2] for r in distance.pairwise_sql(e, "vec_id", "embedding", metric).collect()}
    assert a.keys() == b.keys() and len(a) == 60 * 59 // 2
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


@pytest.mark.parametrize("metric", distance.BINARY)
def test_binary_metrics(spark, metric):
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, size=(6, 20))
    pack = [(i, int("".join(map(str, b)), 2), b.tolist()) for i, b in enumerate(bits)]
    df = spark.createDataFrame(pack, "id int, w long, v array<int>")
    a = {(r[0], r[1]): r[2] for r in distance.pairwise(df, "id", "v", metric).collect()}
    x, y = df.select(F.col("id").alias("i"), F.col("w").alias("p")), df.select(F.col("id").alias("j"), F.col("w").alias("q"))
    b = {(r[0], r[1]): r[2] for r in x.join(y, F.col("i") < F.col("j")).select("i", "j", X.binary_distance(F.col("p"), F.col("q"), 20, metric)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-12 for k in b)


def test_binary_metrics_refuse_other_values(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [1.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="0 and 1"):
        distance.pairwise(df, "id", "v", "dice").collect()


def test_rectangular_pairs(spark):
    df = spark.createDataFrame(HAMMING, "id int, v array<double>, g int")
    got = distance.pairwise(df, "id", "v", "cityblock", ref=df.where("id > 0"), ref_id="id")
    assert got.count() == 6


def test_strings(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "a"), ("über", "uber")], "a string, b string")
    assert [r[0] for r in df.select(distance.string_distance("a", "b")).collect()] == [0.429, 0.0, None, 0.25]
    assert df.select(distance.string_distance("a", "b", "fuzzy").alias("d")).first()["d"] == pytest.approx(1 - round(8 / 13, 3))
    targets = spark.createDataFrame([("sitten",), ("mitten",), ("zzz",)], "t string")
    got = distance.similar_strings(df.where("a = 'kitten'").select("a"), "a", targets, "t", threshold=0.75).orderBy("match").collect()
    assert [(r["match"], r["similarity"]) for r in got] == [("mitten", 0.833), ("sitten", 0.833)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (9, 9)], "a long, b long")
    assert dict(graph.connected_components(edges, tables.settle).collect()) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(chain, tables.settle).select("component").distinct().collect()[0][0] == 0
    assert graph.connected_components(edges.limit(0), tables.settle).count() == 0


def test_clusters(spark):
    v = [(0, [0.0]), (1, [0.1]), (2, [0.2]), (3, [5.0]), (4, [5.1]), (5, [9.0])]
    df = spark.createDataFrame(v, "id long, v array<double>")
    labels = lambda d: [r["Cluster"] for r in d.orderBy("id").collect()]
    assert labels(cluster.component_cluster(df, "id", "v", 0.15)) == [0, 0, 0, 1, 1, 2]
    assert labels(cluster.butina_cluster(df, "id", "v", 0.15)) == [0, 0, 0, 1, 1, 2]
    assert labels(cluster.dbscan_cluster(df, "id", "v", 0.15, 3)) == [0, 0, 0, -1, -1, -1]
    assert labels(cluster.agglomerative_cluster(df, "id", "v", 1.0, "average")) == [0, 0, 0, 1, 1, 2]
    assert labels(cluster.label_values(df.withColumn("s", F.when(F.col("id") < 2, "b").when(F.col("id") < 4, "a")), "s")) == [1, 1, 0, 0, -1, -1]


def test_transformer(spark):
    m = [[1.0, 5.0, 1.0, 2.0], [2.0, 5.0, float("nan"), 9.0], [3.0, 5.0, 2.0, 4.0], [4.0, 5.0, 3.0, 7.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m)], "id int, v array<double>")
    t = transform.VectorTransformer()
    out = t.fit_transform(df, "v", "t")
    assert t.params["kept"] == [0, 3]
    assert all(math.isfinite(x) for r in out.collect() for x in r["t"])
    with pytest.raises(RuntimeError):
        t.fit(df, "v")
    again = transform.VectorTransformer.from_json(t.to_json())
    assert again.transform(df, "v", "t").select("id", "t").collect() == out.select("id", "t").collect()
    with pytest.raises(Exception, match="components"):
        t.transform(spark.createDataFrame([([1.0],)], "v array<double>"), "v").collect()
    assert transform.preset("binary").clipping is None
    assert transform.prune_correlated([(0, 1, 0.95), (1, 2, 0.95), (0, 2, 0.5)], [0, 1, 2]) == [0, 2]


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = np.array([r["p"] for r in transform.pca(df, "v", 2, "p").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(got.var(axis=0), values[:2])


SCORED = [(0, 0.1), (0, 0.6), (1, 0.35), (1, 0.8), (1, 1.0)]


def test_classification(spark):
    df = spark.createDataFrame(SCORED, "y int, s double")
    got = {r["Metric"]: r["Value"] for r in metrics.classification_metrics(df, "y", "s").collect()}
    assert (got["TP"], got["FP"], got["FN"], got["TN"]) == (2, 1, 1, 1)
    assert got["ROC AUC"] == 0.83333 and got["Brier"] == 0.1665 and got["ECE"] == 0.31
    assert metrics.classification_metrics(df.where("y = 1"), "y", "s").count() == 0


def test_masked_loss(spark):
    df = spark.createDataFrame([([1.0], [1.0], ["A"]), ([2.0], [0.0], ["A", "B"]), ([None], [3.0], ["B"])], "p array<double>, y array<double>, tags array<string>")
    got = {(r["Scope"], r["Name"]): r["loss"] for r in metrics.masked_loss(metrics.masked_tasks(df, "y", "p"), "squared", "tags").collect()}
    assert got[("Group", "A")] == 2.0 and got[("Group", "B")] == 4.0 and got[("Total", "Total")] == 2.0


def test_votes(spark):
    p = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 0.0), (2, "b", 1.0)], "row int, unit string, v double")
    assert dict(metrics.vote(p, "row", "v", "mode").collect()) == {1: 1.0, 2: 0.0}
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "unit string, weight double")
    assert dict(metrics.vote(p, "row", "v", "weighted", w).collect()) == {1: 0.25, 2: 0.25}
    with pytest.raises(ValueError):
        metrics.vote(p, "row", "v", "weighted", w.withColumn("weight", F.lit(0.0)))


def test_rounding(spark):
    df = spark.createDataFrame([(0.0,), (1234.5,), (0.00012345,), (None,), (-0.0,)], "v double")
    assert [r[0] for r in df.select(X.round_significant("v", 3)).collect()] == [0.0, 1230.0, 0.000123, None, 0.0]


def test_mann_whitney(spark):
    rows = [("a", float(x)) for x in range(10)] + [("b", float(x) + 5) for x in range(10)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "s string, v double"), "s", "v", "a", "b").first()
    wins = sum((x > y) + 0.5 * (x == y) for x in range(10) for y in range(5, 15))
    assert got["u"] == wins and got["rank_biserial"] == pytest.approx(2 * wins / 100 - 1) and got["relation"] == "<" and got["effect"] == "large"
    few = stats.mann_whitney(spark.createDataFrame(rows[:12], "s string, v double"), "s", "v", "a", "b").first()
    assert few["u"] is None and few["n_b"] == 2


def test_effects(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 9, "rare").when(F.col("id") < 40, "few").otherwise("common").alias("f"), (F.col("id") % 30).alias("r"))
    got = {r["level"]: r for r in stats.effect_levels(df, ["f"], "r").collect()}
    assert got["common"]["outcome"] == "Adequate" and got["common"]["reason"] == ""
    assert got["rare"]["outcome"] == "Insufficient" and got["rare"]["reason"] == "Failed: n_obs|frac"
    assert got["few"]["outcome"] == "Minimal" and got["few"]["reason"] == "Minimal: frac"
    df = df.where("f <> 'few'")
    assert not stats.effect_summary(stats.effect_levels(df, ["f"], "r")).first()["usable"]


def test_text(spark):
    df = spark.createDataFrame([("CCBr",), ("c1cc[nH]c1",)], "s string")
    assert df.select(text.tokens("s")).first()[0] == ["C", "C", "Br"]
    codes = [r["token"] for r in text.alphabet(df, "s").orderBy("code").collect()]
    assert codes[0] == text.PAD and codes[-1] == text.UNK
    coded = text.encode_tokens(df, "s", codes, 10)
    assert [r[0] for r in coded.select(text.decode_tokens("tokens", codes)).collect()] == ["CCBr", "c1cc[nH]c1"]
    with pytest.raises(Exception, match="more tokens"):
        text.encode_tokens(df, "s", codes, 2).collect()
    doc = spark.createDataFrame([("The cats are running to 2 Houses!",)], "t string")
    assert doc.select(text.document_tokens("t")).first()[0] == ["cats", "running", "houses"]
    assert doc.select(text.document_tokens("t", stem=True)).first()[0] == ["cat", "runn", "hous"]
    xml = spark.createDataFrame([("<a><t>x</t></a>",)], "x string")
    assert tuple(xml.select(*text.article_fields("x", {"t": "/a/t", "u": "/a/u"})).first()) == ("x", None)


def test_topics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select(text.document_tokens("text").alias("w"))
    assert text.topics(docs, "w", 3, rounds=3).where("Topic BETWEEN 0 AND 2").count() == 40


def test_features(spark):
    df = spark.createDataFrame([("b",), (None,)], "v string")
    got = [r["h"] for r in features.one_hot_columns(df, ["v"], "h", {"v": ["a", "b"]}).collect()]
    assert got == [[0, 1], [0, 0]]
    with pytest.raises(Exception, match="outside the levels"):
        features.one_hot_columns(df, ["v"], "h", {"v": ["a"]}).collect()
    k = features.Kernel("upper", "math", lambda: str.upper)
    assert sorted(str(r["o"]) for r in features.apply_kernel(df, "v", "o", k).collect()) == ["B", "None"]
    with pytest.raises(ImportError):
        features.Kernel("x", "no_such_library", lambda: str.upper).check()
    assert features.external_process(df.where("v = 'b'"), "v", "o", ["cat"]).first()["o"] == "b"
    assert [r["o"] for r in features.pipeline_clean(df.where("v = 'b'"), "v", [k, k], "o").collect()] == ["B"]


def test_basis(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 2.0, [0.0, 1.0])], "t int, s int, d double, v array<double>")
    radial = features.radial_sums(edges, "t", "d", [1.0], 0.5, 5.0).first()["features"][0]
    fade = lambda d: 0.5 * (math.cos(math.pi * d / 5) + 1)
    assert radial == pytest.approx(fade(1) + math.exp(-0.5) * fade(2))
    angular = features.angular_sums(edges, "t", "s", "v", [math.pi / 2], 1.0).first()["features"][0]
    assert angular == pytest.approx(1.0)
    with pytest.raises(Exception, match="coincident"):
        features.radial_sums(edges.withColumn("d", F.lit(0.0)), "t", "d", [1.0], 0.5, 5.0).collect()


def test_relational(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, k string")
    assert [r["duplicated"] for r in relational.mark_duplicates(df, ["k"]).orderBy("i").collect()] == [True, True, True, True, False]
    one_, many = relational.split_duplicates(df, ["k"])
    assert one_.count() + many.count() == 5
    assert [r["row_id"] for r in relational.row_index(df, F.desc("i")).orderBy(F.desc("i")).collect()] == [0, 1, 2, 3, 4]
    assert relational.keep_first(df, ["k"], "i").orderBy("i").select("i").collect()[0][0] == 1
    with pytest.raises(Exception, match="one to one"):
        relational.one_to_one(df, df, "k").collect()
    assert relational.sample_exact(df, "i", n=2).count() == 2


def test_bounds(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "v double")
    assert bounds.bounds_filter(df, {"v": (0, 2)}).count() == 1
    assert [r[0] for r in bounds.bounds_flag(df, {"v": (2, 4)}).select("_property_violation").collect()] == ["v: 1.00 < 2", "v: 5.00 > 4", ""]
    with pytest.raises(TypeError):
        bounds.bounds_filter(df.select(F.lit("x").alias("v")), {"v": (0, 1)})


def test_modalities(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, t double, w double")
    assert select_modalities(df, {"a": "descriptor", "t": "target", "w": "weight"}).columns == ["a", "y_true", "y_wgts"]
    for bad in ({"a": "x"}, {"t": "target"}, {"a": "x", "t": "target", "w": "target"}):
        with pytest.raises(ValueError):
            validate_modalities(bad)


@pytest.mark.parametrize("name", ["t.csv", "t.tsv", "t.csv.gz", "t.parquet", "t.json", "t.orc"])
def test_round_trip(spark, tmp_path, name):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    tables.write_table(df, f"{tmp_path}/{name}")
    got = tables.read_table(spark, f"{tmp_path}/{name}")
    assert sorted((int(r["i"]), r["s"]) for r in got.collect()) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("kind", ["xz", "zip"])
def test_packed_files(spark, tmp_path, kind):
    (tmp_path / f"t.csv.{kind}").write_bytes(tables.pack(b"i,s\n1,x\n", kind))
    assert tables.read_table(spark, f"{tmp_path}/t.csv.{kind}").collect()[0]["s"] == "x"


@pytest.mark.parametrize("name", ["noext", "t.gz", "t.parquet.gz"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        tables.extensions(name)


def test_pickles_are_refused(spark):
    with pytest.raises(ValueError, match="pickle"):
        tables.read_table(spark, "x.pkl")


def test_sdf_with_either_line_end(spark, tmp_path):
    text = "\n  x\n\nM  END\n> <A>\n1 $$$$ 2\n\n$$$$\nmol2\n\n\nM  END\n> <A>\n3\nmore\n\n$$$$\n"
    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        (tmp_path / f"{name}.sdf").write_bytes(text.replace("\n", end).encode())
        got = tables.read_table(spark, f"{tmp_path}/{name}.sdf").orderBy("name").collect()
        assert [(r["name"], r["properties"]) for r in got] == [("", {"A": "1 $$$$ 2"}), ("mol2", {"A": "3\nmore"})]


def test_hot_keys_give_what_other_keys_give(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(14):
        for _ in range(int(rng.choice([3, 9, 40]))):
            rows.append((k if k else None, float(rng.normal(k, 0.3) + (rng.random() < 0.2) * rng.normal(0, 4)), str(rng.choice(["=", "<", ">"], p=[0.6, 0.2, 0.2]))))
    df = spark.createDataFrame(rows, "k int, v double, r string")
    for fn, cols in ((lambda h: dedup.mad_values(df, "k", "v", hot_rows=h), ["k", "v"]), (lambda h: dedup.censored_values(df, "k", "v", "r", hot_rows=h), ["k", "v", "r"])):
        whole, hot, some = (sorted((tuple(None if x is None else f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in fn(h).select(*cols).collect()), key=str) for h in (10**9, 0, 12))
        assert whole == hot == some and len(whole) == 13


def test_sdf(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("mol1\n  x\n\nM  END\n> <A>\n1\n\n> <B>\ntwo\n\n$$$$\nmol2\n\n\nM  END\n> <A>\n3\n\n$$$$\n")
    got = tables.read_table(spark, f"{tmp_path}/a.sdf").orderBy("name").collect()
    assert [(r["name"], r["properties"]) for r in got] == [("mol1", {"A": "1", "B": "two"}), ("mol2", {"A": "3"})]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [3.0]), (3, None), (4, [1.0, 2.0]), (None, [1.0]), (5, [0.5])], "id long, y array<double>")
    meta = tables.write_store(df, f"{tmp_path}/s", "id", "y", {"negative": F.get("y", F.lit(0)) >= 0})
    assert meta["records"] == 2 and meta["rejects"] == 5 and meta["target_length"] == 1
    assert [r["id"] for r in tables.read_store(spark, f"{tmp_path}/s").orderBy("id").collect()] == [1, 5]
    batch = tables.padded_batches(spark.createDataFrame([([4, 5],)], "t array<int>"), "t", 3).first()
    assert batch["t"] == [4, 5, 0] and batch["mask"] == [True, True, False] and batch["y_wgts"] == 1.0


def test_activity(spark):
    rows = [("C", "100"), ("C", "100"), ("C", "120"), ("N", ">50"), ("O", "1"), ("O", "1000"), ("", "5"), ("S", "bad")]
    got = {r["SMILES"]: round(r["pIC50"], 3) for r in activity.clean_binding(spark.createDataFrame(rows, "SMILES string, `IC50 (nM)` string")).collect()}
    assert got == {"C": round((7 + -math.log10(1.2e-7)) / 2, 3)}
    cols = "Smiles string, `Standard Type` string, Relation string, Units string, `pChEMBL Value` double, Validity string, Assay_Desc string, Type_Target string, Assay_Organism string, Value double"
    human = ("SINGLE PROTEIN", "Homo sapiens", 1e4)
    rows = [
        ("C", "Ki", "'='", "nM", 5.0, "", "wild", *human), ("C", "Ki", "=", "nM", 5.4, None, None, *human), ("N", "Ki", "=", "nM", 5.0, None, "Mutant x", *human),
        ("O", "Ki", ">", "nM", 5.0, None, "wild", *human), ("P", "Ki", "=", "uM", 5.0, None, "wild", *human), ("S", "Ki", "=", "nM", 5.0, None, "wild", "CELL-LINE", "Homo sapiens", 1.0),
        ("F", "Ki", "=", "nM", 5.0, None, "wild", "SINGLE PROTEIN", "Mus musculus", 1.0), ("I", "Ki", "=", "nM", None, None, "wild", *human), ("B", "IC50", "=", "nM", 5.0, None, "wild", *human),
    ]
    got = activity.clean_chembl(spark.createDataFrame(rows, cols), "Ki").collect()
    assert [(r["SMILES"], round(r["pChEMBL_Value"], 6)) for r in got] == [("C", 5.2)]
    with pytest.raises(ValueError):
        activity.clean_chembl(spark.createDataFrame(rows, cols), "EC50")


def test_populations(spark):
    edges = spark.createDataFrame([("m", "a", "b", 7.0), ("m", "b", "c", 8.0)], "mol string, acid string, base string, pka double")
    got = {r["node"]: r["log_weight"] for r in populations.population_fit(edges, "mol", 7.0).collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(0) and got["c"] == pytest.approx(-1)
    listed = spark.createDataFrame([("m", "x, y,x,"), ("n", "")], "mol string, s string")
    states = populations.microstates(listed, "mol", "s")
    assert [tuple(r) for r in states.orderBy("state_id").collect()] == [("m", 0, "x"), ("m", 1, "y")]
    charged = states.withColumn("charge", 1 - F.col("state_id"))
    found, bad = populations.proton_edges(charged)
    assert [tuple(r) for r in found.select("acid", "base").collect()] == [(0, 1)] and bad.count() == 0
    status = dict(populations.graph_status(listed, charged, found).collect())
    assert status == {"m": "CONNECTED", "n": "NO_MICROSTATES"}


def test_evaluation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], "id long, v array<double>, y int")
    folds = split.random_folds(df, 3, "id")
    got = evaluation.evaluate_folds(folds, 3, "v", "y", lambda: evaluation.model("logistic"))
    assert got.where("Metric = 'ROC AUC'").agg(F.min("Value")).first()[0] > 0.9
    curve = evaluation.good_curve(df, "id", "v", [0.05, 0.1], 3, lambda d: d.groupBy("Fold").count())
    assert curve.groupBy("Threshold").agg(F.sum("count").alias("n")).where("n = 90").count() == 2
    assert evaluation.random_parameters({"a": ("int", 1, 3), "b": ("log10", 0.1, 10), "c": ("choice", ["x"])}, 2)[0]["c"] == "x"
    with pytest.raises(ValueError):
        evaluation.model("nothing")


def test_greedy_features():
    gains = {"a": 0.5, "b": 0.3, "c": 0.0, "d": -0.1}
    got = evaluation.greedy_features(lambda names: sum(gains[n] for n in names), list(gains))
    assert got == (["a", "b"], [0.5, 0.8]) and evaluation.greedy_features(lambda n: 1.0, ["x", "y"], 1) == (["x"], [1.0])


def test_histogram_and_residuals(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,)], "v double")
    assert [(r["lo"], r["hi"], r["n"]) for r in metrics.histogram(df, "v", 2).orderBy("bin").collect()] == [(1.0, 2.0, 2), (2.0, 3.0, 1)]
    assert [r["n"] for r in metrics.histogram(df.where("v = 1"), "v", 2).orderBy("bin").collect()] == [2, 0]
    flat = metrics.residuals(df.where("v = 1").withColumn("p", F.lit(1.5)), "v", "p").collect()
    assert {tuple(r) for r in flat} == {(0.5, 0.5, 0.0)}


def test_places_and_sums_of_wide_rows(spark):
    # planned twice, wide rows and their keys alone are cut into unlike numbers of partitions
    n = 40_000
    wide = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(8)])
    rows = spark.range(0, n, 1, 7).select((F.col("id") * 7919 % 40_009).alias("k"), wide.alias("t"))
    places = relational.row_index(rows, "k").orderBy("k").select("row_id", F.length("t").alias("t")).toPandas()
    assert (places["row_id"] == range(n)).all() and (places["t"] == 1024).all()
    total = relational.running_total(rows, [], ["k"], F.lit(1), "before").orderBy("k").select("before", F.length("t").alias("t")).toPandas()
    assert (total["before"] == range(n)).all() and (total["t"] == 1024).all()


def test_outlier_rounds_end_after_so_many(spark):
    # each round takes the values that lie farthest out, one order of magnitude at a time
    values = [0.0, 0.1, 0.2, 0.3, 0.4] * 4 + [10.0**i for i in range(1, 5)]
    df = spark.createDataFrame([("a", v, "=") for v in values] + [("b", 1.0, ">"), ("b", 1.2, ">")], "k string, v double, r string")
    for rounds, agreed in ((None, True), (1, True), (0, False)):
        for hot in (1_000, 3):
            got = dict(dedup.mad_values(df, "k", "v", hot_rows=hot, rounds=rounds).collect())
            assert (got["a"] is not None) == agreed and got["b"] == pytest.approx(1.1)
            got = {r["k"]: (r["v"], r["r"]) for r in dedup.censored_values(df, "k", "v", "r", hot_rows=hot, rounds=rounds).collect()}
            assert got == {"a": (pytest.approx(0.2), "=") if agreed else (None, None), "b": (1.2, ">")}
        kept = dedup.mad_duplicates(df.select("k", "v"), "k", "v", rounds=rounds).where("k = 'a'").agg(F.count("v")).first()[0]
        assert kept == (len(values) if agreed else 0)
        assert dedup.duplicate_tables(df.select("k", "v"), "k", "v", rounds=rounds)["agreed"].count() == 1 + agreed


def test_distances_of_copies_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    v = np.concatenate([base, base, base + 1e-9])
    rows = [(int(i) * 3, x.tolist(), "abc"[i % 3]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string")
    d = np.sqrt(sum((v[:, c, None] - v[None, :, c]) ** 2 for c in range(6)))
    off = np.where(np.eye(len(v), dtype=bool), np.inf, d)
    near = distance.k_neighbors(df, "id", "v", nearest=[3], furthest=[2], block_rows=50).orderBy("id").toPandas()
    assert np.allclose(near["3 Nearest"], np.sort(off, axis=1)[:, :3].mean(axis=1), rtol=0, atol=1e-15)
    assert np.allclose(near["Mean"], d.sum(axis=1) / (len(v) - 1)) and np.allclose(near["Max"], d.max(axis=1))
    found = {(r["src"], r["kind"]): (r["dst"], r["distance"]) for r in distance._nearest(df, "id", "v", "g", "euclidean", 1).collect()}
    g = np.array([r[2] for r in rows])
    for i in range(len(v)):
        for kind, met in (("intra", g == g[i]), ("inter", g != g[i])):
            there = np.where(met, off[i], np.inf)
            assert found[3 * i, kind] == (3 * int(np.argmin(there)), there.min())
    edges = {tuple(r) for r in distance.pairwise(df, "id", "v", threshold=1.5, block_rows=50).collect()}
    assert edges == {tuple(r) for r in distance.pairwise_sql(df, "id", "v", threshold=1.5).collect()}
    assert edges == {(3 * i, 3 * j, d[i, j]) for i in range(len(v)) for j in range(i + 1, len(v)) if d[i, j] <= 1.5}
    every = distance.group_distances(df, "id", "v", "g").groupBy("group", "kind").agg(F.count("*").alias("n"), F.avg("distance"), F.min("distance"), F.max("distance"))
    want = {tuple(r)[:2]: tuple(r)[2:] for r in every.collect()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in distance.group_summary(df, "id", "v", "g").collect()}
    assert got.keys() == want.keys() and all((got[k][0], got[k][2:]) == (want[k][0], want[k][2:]) and got[k][1] == pytest.approx(want[k][1], rel=1e-8) for k in want)


def test_regression_moves_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), (None, 5.0, 4.0), ("b", 2.0, 2.0)], "g string, y double, p double")
    got = metrics.regression_metrics(df, "y", "p", group="g")
    assert {r["Group"]: r["Value"] for r in got.where("Metric = 'MAE'").collect()} == {"Overall": 0.5, "a": 0.5, "b": 0.0}
    assert "hashpartitioning(_g" not in got._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(_k" not in got._jdf.queryExecution().executedPlan().toString()


def test_population_fit_of_text_nodes_and_loose_parts(spark):
    df = spark.createDataFrame([(1, "a", "b", 6.0), (1, "c", "d", 7.0), (2, "a", "a", 7.0), (3, "x", "y", 7.0)], "k long, acid string, base string, pka double")
    got = {(r["component"], r["node"]): r["log_weight"] for r in populations.population_fit(df, "k").collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in {(1, "a"): 0, (1, "b"): 1, (1, "c"): 0, (1, "d"): 0, (2, "a"): 0, (3, "x"): 0, (3, "y"): 0}.items()}


@pytest.mark.parametrize(("n", "cap", "group"), [(400, 4, None), (400, 1, "g"), (60, 9, None)])
def test_capped_radius_edges(spark, n, cap, group):
    """Crowded, sparse and equal places, borders of cells, nulls: the nearest are those over all pairs."""
    rng = np.random.default_rng(n + cap)
    xy = np.concatenate([rng.normal(0, 0.3, (n, 2)), rng.normal(0.02, 0.0005, (n, 2)), np.repeat([[0.5, 0.5], [0.52, 0.5]], 12, axis=0), np.arange(30)[:, None] * [0.02, 0.0]])
    rows = [(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame([*rows, (9990, 0, None, 0.0), (9991, 1, float("inf"), 0.0), (9992, 0, float("nan"), 0.0)], "id long, g int, x double, y double")
    want = {}
    for i, g, x, y in rows:
        near = sorted((math.sqrt((x - p) * (x - p) + (y - q) * (y - q)), j) for j, h, p, q in rows if j != i and (group is None or g == h))
        want[i] = [(j, d) for d, j in near if d <= 0.02][:cap]
    got = {}
    for r in features.radius_edges(df, "id", ["x", "y"], 0.02, cap=cap, group=group).collect():
        got.setdefault(r["src"], []).append((r["distance"], r["dst"]))
    assert {i: [(j, d) for d, j in sorted(e)] for i, e in got.items()} == {i: e for i, e in want.items() if e}
    assert features.radius_edges(df.limit(0), "id", ["x", "y"], 0.02, cap=cap, group=group).count() == 0


def test_capped_radius_edges_make_no_crowd_of_pairs(spark, monkeypatch):
    """All nodes within one radius: what meets grows with the nodes, not with their pairs."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.02, (2000, 2)))], "id long, x double, y double")
    began, plain = [], features.settle

    def settled(d):
        if "_near" in d.columns:
            began.append([r[0] for r in d.select("_level").distinct().collect()])
        return plain(d)

    monkeypatch.setattr(features, "settle", settled)
    assert features.radius_edges(df, "id", ["x", "y"], 0.02, cap=4).count() == 8000
    assert min(began[0]) >= 2  # cells of a quarter of the radius, at the coarsest


@pytest.mark.parametrize("hot_rows", [0, 12, 1000])
def test_mad_rounds_by_arrays_and_by_joins(spark, monkeypatch, hot_rows):
    """Few and many values, ties, a deviation of zero, rounds that run out: the same whichever way a key goes; keys with few values settle no rounds."""
    rng = np.random.default_rng(18)
    data = {k: np.r_[rng.normal(5, 0.3, size=rng.integers(1, 30)), rng.normal(5, 4, size=rng.integers(0, 5))] for k in range(30)}
    data |= {100: [5.0, 5.0, 9.0], 101: [1.0], 102: [0.0, 0.1, 1.0, 1.2, 30.0], 103: np.round(rng.normal(5, 0.4, 25), 1)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [(None, 1.0), (1, None), (1, float("nan"))], "k int, v double").repartition(3)
    settled, plain = [], dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda d: settled.append(d) or plain(d))
    for rounds in (0, 1, 6):
        settled.clear()
        got = {r["k"]: r["v"] for r in dedup.mad_rounds(df, "k", "v", rounds, hot_rows=hot_rows).collect()}
        want = {k: dedup.consensus(np.asarray(v), 1.0, 3.5, rounds) for k, v in data.items()}
        assert got.keys() == want.keys()
        assert all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in want)
        assert hot_rows < 1000 or len(settled) == 1


def test_expressions_on_pairs_shuffle_no_pair(spark, sf_dir):
    """The vectors come with the pairs: nothing is joined to them, and the vectors of blocks stay floats."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200)
    df = distance.pairwise_sql(e, "vec_id", "embedding", threshold=1.15)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ("src" in line or "dst" in line)]
    assert e.select(distance._plain(e, "embedding")).dtypes[0][1] == "array<float>"
    want = {tuple(r) for r in distance.pairwise_sql(e, "vec_id", "embedding").where("distance <= 1.15").collect()}
    assert {tuple(r) for r in df.collect()} == want and len(want) > 5
