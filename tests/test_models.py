"""Mixed models against a dense likelihood and closed forms, topic coherence against windows that are made."""

import math

import numpy as np
import pyarrow as pa
import pytest

from brindle.operators import stats, text
from brindle.plans import evaluation


def dense_fit(x, y, groups):
    """(coefficients, their covariance, group variance, residual variance, criterion) from the whole covariance matrix."""
    n, p = x.shape
    same = (groups[:, None] == groups[None]).astype(float)

    def at(ratio):
        v = np.linalg.inv(np.eye(n) + ratio * same)
        a = x.T @ v @ x
        beta = np.linalg.solve(a, x.T @ v @ y)
        r = y - x @ beta
        s = float(r @ v @ r) / (n - p)
        return (n - p) * (math.log(2 * math.pi * s) + 1) - np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, np.linalg.inv(a) * s, ratio * s, s

    low, high = -12.0, 6.0
    for _ in range(70):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if at(math.exp(a))[0] <= at(math.exp(b))[0] else (a, high)
    best = min((at(math.exp(low)), at(0.0)), key=lambda r: r[0])
    return best[1], best[2], best[3], best[4], best[0]


@pytest.mark.parametrize("seed,spread", [(1, 2.0), (2, 0.4), (3, 0.0)])
def test_mixed_model_against_the_dense_likelihood(spark, seed, spread):
    rng = np.random.default_rng(seed)
    n, groups = 180, rng.integers(0, 25, 180)
    dose, kind = rng.normal(5e4, 10, n), rng.integers(0, 3, n)
    y = 1e3 + 2.5 * dose + np.array([0, 4, -3])[kind] + rng.normal(0, spread, 25)[groups] + rng.normal(0, 1, n)
    rows = [(float(a), f"g{g}", float(b), "abc"[k]) for a, g, b, k in zip(y, groups, dose, kind)] + [(None, "g1", 1.0, "a"), (1.0, None, 1.0, "a"), (2.0, "g1", float("nan"), "b")]
    df = spark.createDataFrame(rows, "y double, g string, dose double, kind string").repartition(3)
    got = stats.mixed_model(df, "y", "g", ["dose"], ["kind"])
    x = np.c_[np.ones(n), dose, kind == 1, kind == 2].astype(float)
    x[:, 1] -= dose.mean()  # else the dense version loses digits
    beta, covariance, between, within, criterion = dense_fit(x, y, groups)
    assert got.terms == ("(Intercept)", "dose", "kind=b", "kind=c") and got.rows == n and got.groups == len(set(groups))
    assert np.allclose(got.coefficients[1:], beta[1:], rtol=1e-6, atol=1e-6) and np.isclose(got.coefficients[0], beta[0] - beta[1] * dose.mean(), rtol=1e-6)
    assert np.allclose(got.errors[1:], np.sqrt(np.diag(covariance))[1:], rtol=1e-4)
    assert np.isclose(got.residual_variance, within, rtol=1e-4) and np.isclose(got.group_variance, between, rtol=1e-3, atol=1e-3)
    assert np.isclose(got.icc, between / (between + within), atol=1e-3) and np.isclose(got.criterion, criterion, atol=1e-4)
    fitted = np.var(x @ beta)
    assert np.isclose(got.r2_conditional, (fitted + between) / (fitted + between + within), atol=1e-4)
    assert got.table(spark).where("part = 'fixed'").count() == 4


def test_mixed_model_balanced_has_closed_forms(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(0, 1, (30, 6)) + rng.normal(0, 1.5, 30)[:, None]
    df = spark.createDataFrame([(float(v), i) for i, row in enumerate(y) for v in row], "y double, g int")
    got = stats.mixed_model(df, "y", "g")
    within = y.var(axis=1, ddof=1).mean()
    assert np.isclose(got.residual_variance, within, rtol=1e-6)
    assert np.isclose(got.group_variance, y.mean(axis=1).var(ddof=1) - within / 6, rtol=1e-5)
    assert np.isclose(got.coefficients[0], y.mean()) and not got.singular and got.inflation == {}
    with pytest.raises(ValueError):
        stats.mixed_model(df.limit(1), "y", "g")


def test_topic_coherence_against_windows(spark):
    rng = np.random.default_rng(2)
    docs = [(i, [str(w) for w in rng.choice(list("abcdefgh"), int(k), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])]) for i, k in enumerate(rng.integers(0, 30, 40))] + [(99, None)]
    topics = [("x", "a"), ("x", "c"), ("x", "d"), ("y", "b"), ("y", "h"), ("y", "none"), ("z", "a"), ("x", "a"), ("z", None)]
    size = 5
    windows = [set(ws[s : s + size]) for _, ws in docs if ws for s in range(max(1, len(ws) - size + 1))]
    share = lambda *w: sum(all(v in s for v in w) for s in windows) / len(windows)
    want = {}
    for t in "xyz":
        words = sorted({w for k, w in topics if k == t and w})
        npmi = np.array([[math.log((share(a, b) + 1e-12) / (share(a) * share(b))) / -math.log(share(a, b) + 1e-12) if share(a) and share(b) else 0.0 for b in words] for a in words])
        total = npmi.sum(axis=0)
        want[t] = np.mean([v @ total / (np.linalg.norm(v) * np.linalg.norm(total)) if v.any() and total.any() else 0.0 for v in npmi])
    df = spark.createDataFrame(docs, "id long, ws array<string>")
    got = {r["topic"]: r["coherence"] for r in text.topic_coherence(df, "id", "ws", spark.createDataFrame(topics, "topic string, word string"), window=size).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("slice_words", [1, 7, 1 << 18])
def test_topic_coherence_shuffles_no_places(monkeypatch, slice_words):
    """A task gives one row a pair, however many places its texts have, and however they are sliced."""
    rng = np.random.default_rng(4)
    texts = [None, [], *[[str(w) for w in rng.choice(list("abcde"), int(k))] for k in rng.integers(1, 40, 60)]]
    monkeypatch.setattr(text, "SLICE_WORDS", slice_words)
    pairs = np.array([(0, 0), (0, 1), (0, 2), (1, 1), (2, 2)])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], names=["ws"])
    got = [r for out in text._either(["a", "c", "none"], pairs, 5)(iter([batch.slice(0, 20), batch.slice(20)])) for r in out.to_pylist()]
    windows = [set(ws[s : s + 5]) for ws in texts if ws for s in range(max(1, len(ws) - 4))]
    holds = lambda *w: sum(any(v in s for v in w) for s in windows)
    assert {(r["a"], r["b"]): r["n"] for r in got} == {(-1, -1): len(windows), (0, 0): holds("a"), (0, 1): holds("a", "c"), (0, 2): holds("a"), (1, 1): holds("c")}
    assert len(got) == 5


SPACE = {"x": ("uniform", -3.0, 3.0), "rate": ("log10", 1e-4, 1.0), "depth": ("int", 1, 9), "kind": ("choice", ["a", "b", "c"])}


def loss(p):
    if p["kind"] == "c":
        raise ValueError("no such kind")
    return (p["x"] - 1) ** 2 + (math.log10(p["rate"]) + 2) ** 2 + 0.1 * (p["depth"] - 4) ** 2 + (p["kind"] == "a")


def test_adaptive_search_learns_and_is_reproducible():
    found, drawn = [], []
    for seed in range(6):
        tried = evaluation.adaptive_search(loss, SPACE, 60, maximize=False, seed=seed)
        assert tried == evaluation.adaptive_search(loss, SPACE, 60, maximize=False, seed=seed)
        assert [t.number for t in tried] == list(range(60)) and all(1 <= t.params["depth"] <= 9 and -3 <= t.params["x"] <= 3 and 1e-4 <= t.params["rate"] <= 1 for t in tried)
        assert {t.reason for t in tried if t.value is None} == {"ValueError: no such kind"}
        late = [t for t in tried[30:] if t.value is None]
        assert len(late) <= 6  # a third at random
        found.append(evaluation.best_trial(tried, False).value)
        drawn.append(min(loss(p) for p in evaluation.random_parameters(SPACE, 60, seed) if p["kind"] != "c"))
    assert np.mean(found) < 0.6 * np.mean(drawn)


def test_adaptive_search_in_threads(spark):
    import time

    def slow(p):
        time.sleep(0.01 * p["depth"])
        return loss(p)

    one, two = (evaluation.adaptive_search(f, SPACE, 30, maximize=False, seed=3, parallel=4) for f in (slow, loss))
    assert one == two and len(one) == 30
    rows = evaluation.trial_table(spark, one).orderBy("number").collect()
    assert [r["state"] == "pruned" for r in rows] == [t.value is None for t in one]
    with pytest.raises(ValueError):
        evaluation.best_trial([t for t in one if t.value is None])
    assert all(t.value is None for t in evaluation.adaptive_search(lambda p: float("nan"), SPACE, 3))


def test_search_over_folds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(v.tolist(), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y))], "v array<double>, y double, Fold int")
    params, value, tried = evaluation.search(df, 2, "v", "y", "linear", {"regParam": ("log10", 1e-3, 10.0)}, 3, "RMSE", classifier=False, parallel=3)
    assert value == min(t.value for t in tried) and params["regParam"] == min(t.params["regParam"] for t in tried)


def test_sequential_features():
    gains = {"a": 0.5, "b": 0.3, "c": -0.1, "d": -0.2, "e": 0.05}
    score = lambda names: sum(gains[n] for n in names) + (2.0 if {"c", "d"} <= set(names) else 0)
    assert evaluation.sequential_features(score, list(gains), 5, patience=1) == (["a", "b", "e"], pytest.approx([0.5, 0.8, 0.85, 0.75]))
    names, scores = evaluation.sequential_features(score, list(gains), 5, patience=3, parallel=2)
    assert names == list(gains) and len(scores) == 5
    plain = lambda names: -sum(gains[n] for n in names)
    assert evaluation.sequential_features(plain, list(gains), 9, "backward", 1, maximize=False)[0] == ["a", "b", "e"]
    assert evaluation.sequential_features(plain, ["a", "b"], 9, "backward")[0] == ["b"]
    with pytest.raises(ValueError):
        evaluation.sequential_features(plain, ["a"], 1, "sideways")
