"""Training and evaluation over folds with Spark's own models, and split quality over a range of thresholds."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.cluster import component_cluster
from brindle.operators.distance import pairwise
from brindle.operators.metrics import classification_metrics, regression_metrics
from brindle.operators.split import Folds, group_folds
from brindle.sources.tables import settle


def model(name: str, **params):
    """An unfitted model by name: logistic, forest_classifier, boosted_classifier, linear, forest_regressor, boosted_regressor."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    kinds = {
        "logistic": c.LogisticRegression, "forest_classifier": c.RandomForestClassifier, "boosted_classifier": c.GBTClassifier,
        "linear": r.LinearRegression, "forest_regressor": r.RandomForestRegressor, "boosted_regressor": r.GBTRegressor,
    }
    if name not in kinds:
        raise ValueError(f"no model {name!r}; there are {sorted(kinds)}; others need a library of their own")
    return kinds[name](featuresCol="_features", labelCol="_label", **params)


def random_parameters(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n draws from name -> ('uniform' | 'int' | 'log10', low, high) or ('choice', values)."""
    rng = random.Random(seed)
    draw = {
        "uniform": lambda a, b: rng.uniform(a, b), "int": lambda a, b: rng.randint(a, b),
        "log10": lambda a, b: 10 ** rng.uniform(math.log10(a), math.log10(b)), "choice": lambda values: rng.choice(list(values)),
    }
    return [{k: draw[v[0]](*v[1:]) for k, v in space.items()} for _ in range(n)]


#: Trials drawn at random before the good ones guide the draws, and draws of which the most promising is tried.
STARTUP_TRIALS, DRAWS = 10, 24
#: Metrics of which less is better.
LESS_IS_BETTER = ("RMSE", "MAE", "Loss")


@dataclass(frozen=True)
class Trial:
    """One try of a search: value is None where it was pruned, and reason then says why."""

    number: int
    params: dict
    value: float | None
    reason: str | None = None


class Parzen:
    """Draws of one parameter from a mixture around given places, all in [0, 1], and a wide prior; of a choice, from smoothed shares."""

    def __init__(self, places: list[float], kinds: int | None = None) -> None:
        self.kinds = kinds
        if kinds:
            self.shares = [(1 + sum(p == k for p in places)) / (kinds + len(places)) for k in range(kinds)]
            return
        self.centres = sorted([*places, 0.5])
        around = [0.0, *self.centres, 1.0]
        widths = [max(around[i + 1] - around[i], around[i + 2] - around[i + 1]) for i in range(len(self.centres))]
        least = 1 / min(100, len(self.centres) + 1)
        self.widths = [min(1.0, max(w, least)) for w in widths]
        self.widths[self.centres.index(0.5)] = 1.0

    def draw(self, rng: random.Random) -> float:
        if self.kinds:
            return rng.choices(range(self.kinds), self.shares)[0]
        k = rng.randrange(len(self.centres))
        while True:
            x = rng.gauss(self.centres[k], self.widths[k])
            if 0 <= x <= 1:
                return x

    def log_density(self, x: float) -> float:
        if self.kinds:
            return math.log(self.shares[int(x)])
        total = 0.0
        for c, w in zip(self.centres, self.widths, strict=True):
            inside = 0.5 * (math.erf((1 - c) / w / math.sqrt(2)) - math.erf(-c / w / math.sqrt(2)))
            total += math.exp(-0.5 * ((x - c) / w) ** 2) / w / inside
        return math.log(max(total / len(self.centres), 1e-300))


def _in_thread(f: Callable) -> Callable:
    """f for a thread of its own, with this one's Spark properties where there is a Spark."""
    return inheritable_thread_target(f) if SparkContext._active_spark_context else f


def _place(rule: tuple, value) -> float:
    kind, *of = rule
    if kind == "choice":
        return list(of[0]).index(value)
    low, high = (math.log10(of[0]), math.log10(of[1])) if kind == "log10" else (of[0] - 0.5, of[1] + 0.5) if kind == "int" else of
    at = math.log10(value) if kind == "log10" else value
    return (at - low) / (high - low) if high > low else 0.5


def _value(rule: tuple, place: float):
    kind, *of = rule
    if kind == "choice":
        return list(of[0])[int(place)]
    if kind == "log10":
        return 10 ** (math.log10(of[0]) + place * (math.log10(of[1]) - math.log10(of[0])))
    if kind == "int":
        return min(of[1], max(of[0], round(of[0] - 0.5 + place * (of[1] - of[0] + 1))))
    return of[0] + place * (of[1] - of[0])


def suggest(space: dict[str, tuple], done: Sequence[Trial], rng: random.Random, maximize: bool = True, startup: int = STARTUP_TRIALS) -> dict:
    """The next parameters to try (tree-structured Parzen estimator): of DRAWS values that good trials make likely, for each
    parameter the one that the other trials make least likely. Pruned trials count among the others."""
    known = sorted((t for t in done if t.value is not None), key=lambda t: (-t.value if maximize else t.value, t.number))
    if len(known) < startup:
        return random_parameters(space, 1, rng.randrange(1 << 30))[0]
    n = min(25, math.ceil(0.1 * len(known)))
    good, others = known[:n], [*known[n:], *(t for t in done if t.value is None)]
    out = {}
    for name, rule in space.items():
        kinds = len(list(rule[1])) if rule[0] == "choice" else None
        likely, plain = (Parzen([_place(rule, t.params[name]) for t in part], kinds) for part in (good, others))
        drawn = [likely.draw(rng) for _ in range(DRAWS)]
        out[name] = _value(rule, max(drawn, key=lambda x: likely.log_density(x) - plain.log_density(x)))
    return out


def adaptive_search(objective: Callable[[dict], float | None], space: dict[str, tuple], trials: int, maximize: bool = True, seed: int = 42, parallel: int = 1, startup: int = STARTUP_TRIALS) -> list[Trial]:
    """The trials of a search for the parameters with the best objective.

    parallel trials run at once, each in a thread whose Spark jobs go to a scheduler pool of their own (with FAIR scheduling
    they share the cluster); their values guide the next ones when all of them are there, so a seed gives the same trials however long each takes.
    A trial that raises an error of its values, or gives none or no finite one, is pruned.
    """
    done: list[Trial] = []

    def run(number: int, params: dict) -> Trial:
        if spark := SparkSession.getActiveSession():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial{number % parallel}")
        try:
            value = objective(dict(params))
        except (ValueError, TypeError, ArithmeticError) as e:
            return Trial(number, params, None, f"{type(e).__name__}: {e}")
        ok = value is not None and math.isfinite(value)
        return Trial(number, params, float(value) if ok else None, None if ok else "no finite value")

    rng = random.Random(seed)
    while len(done) < trials:
        asked = [suggest(space, done, rng, maximize, startup) for _ in range(min(parallel, trials - len(done)))]
        with ThreadPoolExecutor(len(asked)) as pool:
            waiting = [pool.submit(_in_thread(run), len(done) + i, p) for i, p in enumerate(asked)]
            done += [w.result() for w in waiting]
    return done


def best_trial(trials: Sequence[Trial], maximize: bool = True) -> Trial:
    """The first of the best trials; an error if all were pruned."""
    known = [t for t in trials if t.value is not None]
    if not known:
        raise ValueError("every trial was pruned")
    return (max if maximize else min)(known, key=lambda t: t.value)


def trial_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """(number, state, value, params, reason): a row a trial, params as JSON."""
    rows = [(t.number, "complete" if t.value is not None else "pruned", t.value, json.dumps(t.params, sort_keys=True), t.reason) for t in trials]
    return spark.createDataFrame(rows, "number int, state string, value double, params string, reason string")


def _shaped(df: DataFrame, vector: str, target: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_label", F.col(target).cast("double"))


def score_fold(train: DataFrame, test: DataFrame, vector: str, target: str, make: Callable, group: str | None = None, classifier: bool = True) -> DataFrame:
    fitted = make().fit(_shaped(train, vector, target))
    out = fitted.transform(_shaped(test, vector, target))
    if classifier:
        return classification_metrics(out.withColumn("_score", vector_to_array("probability")[1]), "_label", "_score", group=group)
    return regression_metrics(out, "_label", "prediction", group=group)


def evaluate_folds(df: DataFrame, k: int, vector: str, target: str, make: Callable, fold_col: str = "Fold", group: str | None = None, classifier: bool = True) -> DataFrame:
    """(Metric, Value, Group, Fold) with each fold held out once."""
    folds, out = Folds(df, fold_col), None
    for fold in range(k):
        got = score_fold(folds.train(fold), folds.evaluation(fold), vector, target, make, group, classifier).withColumn("Fold", F.lit(fold))
        out = got if out is None else out.unionByName(got)
    return out


def search(df: DataFrame, k: int, vector: str, target: str, name: str, space: dict[str, tuple], trials: int, metric: str, fold_col: str = "Fold", seed: int = 42, classifier: bool = True, parallel: int = 1) -> tuple[dict, float, list[Trial]]:
    """(parameters, value, trials): the parameters of a model with the best mean metric over folds, by adaptive_search()."""
    maximize = metric not in LESS_IS_BETTER

    def objective(params: dict) -> float | None:
        got = evaluate_folds(df, k, vector, target, lambda: model(name, **params), fold_col, classifier=classifier)
        return got.where((F.col("Metric") == metric) & (F.col("Group") == "Overall")).agg(F.avg("Value")).first()[0]

    tried = adaptive_search(objective, space, trials, maximize, seed, parallel)
    best = best_trial(tried, maximize)
    return best.params, best.value, tried


def good_curve(df: DataFrame, id_col: str, vector: str, thresholds: Sequence[float], k: int, evaluate: Callable[[DataFrame], DataFrame], metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """evaluate(df with Fold) for folds that keep clusters whole, at each threshold. Edges are computed once, at the largest threshold."""
    edges, out = settle(pairwise(df, id_col, vector, metric, max(thresholds))), None
    for t in sorted(thresholds):
        clustered = component_cluster(df, id_col, vector, t, metric, edges.where(F.col("distance") <= t))
        if clustered.select("Cluster").distinct().count() < k:
            break
        got = evaluate(group_folds(settle(clustered), k, "Cluster", seed)).withColumn("Threshold", F.lit(float(t)))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no threshold leaves enough clusters")
    return out


def greedy_features(score: Callable[[list[str]], float], candidates: Sequence[str], most: int | None = None, least_gain: float = 0.0) -> tuple[list[str], list[float]]:
    """(features, scores): again and again the candidate whose addition scores best (the first on ties), while it gains more than least_gain.

    score() evaluates a list of features, for instance by evaluate_folds() over merge_vectors(); higher is better.
    """
    chosen: list[str] = []
    scores: list[float] = []
    while len(chosen) < min(len(candidates), most or len(candidates)):
        tried = [(score([*chosen, c]), -i, c) for i, c in enumerate(candidates) if c not in chosen]
        value, _, name = max(tried)
        if scores and value - scores[-1] <= least_gain:
            break
        chosen.append(name)
        scores.append(value)
    return chosen, scores


def sequential_features(score: Callable[[list[str]], float], candidates: Sequence[str], steps: int, direction: str = "forward", patience: int = 5, maximize: bool = True, parallel: int = 1) -> tuple[list[str], list[float]]:
    """(features, the best score of each step): features added to none, or taken from all, one a step, the one that leaves the best score.

    A step that does not improve on the best score so far is taken nevertheless, but after so many of them in a row (patience) the selection
    ends; the features are those at the best score, the first on ties, in the order of candidates. score() evaluates a list of features in that order;
    parallel candidates are scored at once.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    now = [] if direction == "forward" else list(candidates)
    kept, best, scores, waited = list(now), None, [], 0
    for _ in range(min(steps, len(candidates) - (direction == "backward"))):
        moves = [c for c in candidates if (c in now) == (direction == "backward")]
        tried = [[x for x in candidates if (x in now) != (x == c)] for c in moves]
        with ThreadPoolExecutor(parallel) as pool:
            values = [float(v) for v in pool.map(_in_thread(score), tried)]
        at = max(range(len(values)), key=lambda i: (values[i] if maximize else -values[i], -i))
        now = tried[at]
        scores.append(values[at])
        if best is None or (values[at] > best if maximize else values[at] < best):
            kept, best, waited = now, values[at], 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept, scores
