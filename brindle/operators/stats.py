"""Statistical checks: coverage of effects' levels, rank-sum tests, linear mixed models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.expr import round_significant, safe_div
from brindle.operators.relational import exact_quantiles, running_total

# Outcomes, worst first.
OUTCOMES = ("Insufficient", "Minimal", "Sufficient", "Adequate")


#: Levels of a factor among the fixed effects; each is a column of the design.
MOST_LEVELS = 200


@dataclass(frozen=True)
class Coverage:
    """Least values, for all outcomes but the worst, of a level's rows, its share of all rows and its distinct random levels."""

    # Fixed values.
    count: tuple[float, float, float] = (10, 30, 100)
    fraction: tuple[float, float, float] = (0.02, 0.05, 0.1)
    random: tuple[float, float, float] = (5, 10, 20)


def effect_levels(df: DataFrame, fixed: Sequence[str], random: str, limits: Coverage = Coverage()) -> DataFrame:
    """(effect, level, n, fraction, n_random, outcome, reason) for each level of each fixed effect.

    fraction is of all rows, three significant digits. The worst of the three checks (n_obs, frac and the random effect's
    name) decides; reason names those that limit a level that is Insufficient or Minimal.
    """
    total = df.agg(F.count("*").alias("_total"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("effect"), F.col(c).cast("string").alias("level")) for c in fixed]))
    rows = df.select(F.col(random).alias("_r"), each.alias("e")).select("_r", "e.*")
    per = rows.where("level IS NOT NULL").groupBy("effect", "level").agg(F.count("*").alias("n"), F.count_distinct("_r").alias("n_random"))
    per = per.crossJoin(F.broadcast(total)).withColumn("fraction", round_significant(F.col("n") / F.col("_total"), 3)).drop("_total")
    step = lambda c, least: sum(((F.col(c) >= x).cast("int") for x in least), F.lit(0))
    steps = {"n_obs": step("n", limits.count), "frac": step("fraction", limits.fraction), random: step("n_random", limits.random)}
    worst = F.least(*steps.values())
    names = F.array(*map(F.lit, OUTCOMES))
    limiting = F.array_join(F.array_compact(F.array(*[F.when(s == worst, F.lit(k)) for k, s in steps.items()])), "|")
    reason = F.when(worst == 0, F.concat(F.lit("Failed: "), limiting)).when(worst == 1, F.concat(F.lit("Minimal: "), limiting)).otherwise("")
    return per.select("effect", "level", "n", "fraction", "n_random", F.get(names, worst).alias("outcome"), reason.alias("reason"))


def effect_summary(levels: DataFrame) -> DataFrame:
    """(effect, n_levels, n_valid, usable): an effect needs two levels that are not Insufficient."""
    valid = F.count(F.when(F.col("outcome") != OUTCOMES[0], 1))
    return levels.groupBy("effect").agg(F.count("*").alias("n_levels"), valid.alias("n_valid"), (valid >= 2).alias("usable"))


def erfc_column(x):
    """The complementary error function, for which there is no built-in: a vectorised function over Arrow batches."""

    def run(x):
        return x.map(lambda v: None if v is None or v != v else math.erfc(v))

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(x)


def mann_whitney(df: DataFrame, sample: str, value: str, a: str, b: str, min_n: int = 5, alpha: float = 0.05) -> DataFrame:
    """One row: n_a, n_b, median_a, median_b, u, rank_biserial, effect, p, relation.

    Ranks are mid-ranks; p is the two-sided normal approximation with tie and continuity corrections. With fewer than
    min_n values on a side, everything but the counts is null. Ranks come from counts of distinct values in prefix sums.
    """
    rows = df.where(F.col(sample).isin(a, b)).select((F.col(sample) == a).alias("a"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    halves = exact_quantiles(rows, ["a"], "v", [0.5])
    side = lambda c: F.max(F.when(c, F.get("q", F.lit(0))))
    med = halves.agg(side(F.col("a")).alias("median_a"), side(~F.col("a")).alias("median_b"))
    points = rows.groupBy("v").agg(F.count(F.when(F.col("a"), 1)).alias("na"), F.count(F.when(~F.col("a"), 1)).alias("nb"))
    points = running_total(points, [], ["v"], "nb", "below")
    t = F.col("na") + F.col("nb")
    sums = points.agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * (F.col("below") + F.col("nb") / 2)).alias("u"), F.sum((t * t * t - t).cast("double")).alias("ties"),
    )
    n = F.col("n_a") + F.col("n_b")
    pairs = F.col("n_a") * F.col("n_b")
    sd = F.sqrt(safe_div(pairs, F.lit(12.0)) * (n + 1 - safe_div(F.col("ties"), n * (n - 1))))
    gap = F.abs(F.col("u") - pairs / 2)
    z = safe_div(F.greatest(gap - 0.5, F.lit(0.0)), sd)
    out = sums.crossJoin(med).withColumn("enough", (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    keep = lambda c: F.when(F.col("enough"), c)
    out = out.withColumn("rank_biserial", keep(safe_div(2 * F.col("u"), pairs) - 1)).withColumn("p", keep(erfc_column(z / math.sqrt(2))))
    size = F.abs(F.col("rank_biserial"))
    effect = F.when(size < 0.1, "negligible").when(size < 0.3, "small").when(size < 0.5, "medium").otherwise("large")
    relation = F.when((F.col("p") < alpha) & (F.col("rank_biserial") > 0), ">").when((F.col("p") < alpha) & (F.col("rank_biserial") < 0), "<").otherwise("=")
    return out.select("n_a", "n_b", keep(F.col("median_a")).alias("median_a"), keep(F.col("median_b")).alias("median_b"), keep(F.col("u")).alias("u"), "rank_biserial", keep(effect).alias("effect"), "p", keep(relation).alias("relation"))


@dataclass(frozen=True)
class MixedModel:
    """A linear mixed model with a random intercept, fitted by restricted likelihood.

    terms, coefficients, errors: the fixed effects, the intercept first, and their standard errors; covariance: theirs. group_variance,
    residual_variance, icc (the group's share of both), r2_marginal (of the fixed effects) and r2_conditional (with the group's);
    inflation: variance inflation of each term but the intercept; criterion: -2 log restricted likelihood; singular: no
    variance between groups.
    """

    terms: tuple[str, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    group_variance: float
    residual_variance: float
    r2_marginal: float
    r2_conditional: float
    inflation: dict[str, float]
    criterion: float
    rows: int
    groups: int

    @property
    def errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def icc(self) -> float:
        return self.group_variance / (self.group_variance + self.residual_variance)

    @property
    def singular(self) -> bool:
        return self.group_variance <= 1e-9 * self.residual_variance

    def table(self, spark: SparkSession) -> DataFrame:
        """(part, name, value, error, statistic): fixed effects, variances and shares, a row each."""
        rows = [("fixed", n, float(v), float(e), float(v / e)) for n, v, e in zip(self.terms, self.coefficients, self.errors, strict=True)]
        rows += [("variance", n, float(v), None, None) for n, v in (("group", self.group_variance), ("residual", self.residual_variance))]
        rows += [("share", n, float(v), None, None) for n, v in (("icc", self.icc), ("r2_marginal", self.r2_marginal), ("r2_conditional", self.r2_conditional))]
        rows += [("inflation", n, float(v), None, None) for n, v in self.inflation.items()]
        return spark.createDataFrame(rows, "part string, name string, value double, error double, statistic double")


def mixed_model(df: DataFrame, y: str, group: str, numeric: Sequence[str] = (), factors: Sequence[str] = ()) -> MixedModel:
    """y ~ numeric + factors + (1 | group) by restricted maximum likelihood; rows with a missing value are left out.

    Factors are coded against their first level. The likelihood needs of the rows only their number and sums in each group, and of
    the groups only sums over those of the same size: rows are aggregated to groups, groups to sizes, of which n rows have at
    most sqrt(2 n), and these few sums are all that the search for the ratio of variances reads.
    """

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))

    ok = F.col(group).isNotNull()
    for c in (y, *numeric):
        ok = ok & finite(c)
    for c in factors:
        ok = ok & F.col(c).isNotNull()
    rows = df.where(ok)
    dummies = []
    for c in factors:
        levels = [r[0] for r in rows.select(c).distinct().orderBy(c).limit(MOST_LEVELS + 1).collect()]
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels; use it as the group")
        dummies += [(f"{c}={v}", F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)) for v in levels[1:]]
    columns = [(c, F.col(c).cast("double")) for c in numeric] + dummies
    terms = ("(Intercept)", *[name for name, _ in columns])
    # centred and scaled, so that sums of squares lose nothing
    values = [F.col(y).cast("double"), *[c for _, c in columns]]
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
    n, p = moments["n"], len(terms)
    if n <= p:
        raise ValueError("there are no more rows than fixed effects")
    mean, scale = (np.array([moments[f"{k}{i}"] for i in range(p)]) for k in "ms")
    if (scale[1:] == 0).any():
        raise ValueError(f"{[t for t, s in zip(terms[1:], scale[1:], strict=True) if s == 0]} are constant")
    scale[0] = scale[0] or 1.0
    coded = rows.select(F.col(group).alias("g"), *[((v - float(m)) / float(s)).alias(f"v{i}") for i, (v, m, s) in enumerate(zip(values, mean, scale, strict=True))])
    v = [F.lit(1.0), *[F.col(f"v{i}") for i in range(1, p)], F.col("v0")]  # the design, then y
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sizes = coded.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(v)])
    by_size = sizes.groupBy("n").agg(F.count("*").alias("k"), *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"c{i}_{j}") for i, j in cells])
    whole = coded.agg(*[F.sum(v[i] * v[j]).alias(f"c{i}_{j}") for i, j in cells]).first()

    def square(r) -> np.ndarray:
        out = np.zeros((p + 1, p + 1))
        for i, j in cells:
            out[i, j] = out[j, i] = r[f"c{i}_{j}"]
        return out

    every = square(whole)
    found = by_size.orderBy("n").collect()
    size, many, inner = np.array([r["n"] for r in found], dtype=float), np.array([r["k"] for r in found], dtype=float), np.array([square(r) for r in found])

    def solved(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        """(criterion, coefficients, their covariance over the residual variance, residual variance) at a ratio of variances."""
        m = every - np.tensordot(ratio / (1 + size * ratio), inner, axes=1)
        a, b = m[:p, :p], m[:p, p]
        beta = np.linalg.solve(a, b)
        variance = float(m[p, p] - b @ beta) / (n - p)
        return float((n - p) * np.log(variance) + many @ np.log1p(size * ratio) + np.linalg.slogdet(a)[1]), beta, np.linalg.inv(a), variance

    grid = np.linspace(-14, 14, 113)
    at = int(np.argmin([solved(np.exp(x))[0] for x in grid]))
    low, high, golden = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)], (5**0.5 - 1) / 2
    for _ in range(80):
        x, z = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, z) if solved(np.exp(x))[0] <= solved(np.exp(z))[0] else (x, high)
    ratio = float(np.exp((low + high) / 2))
    ratio = 0.0 if solved(0.0)[0] <= solved(ratio)[0] else ratio
    criterion, beta, covariance, variance = solved(ratio)
    # back to the columns' own units
    back = np.diag([1.0, *(1 / scale[1:])])
    back[0, 1:] = -mean[1:] / scale[1:]
    spread = every[1:p, 1:p] / n  # the coded columns' correlations
    fixed = float(beta[1:] @ spread @ beta[1:])
    unit = scale[0] ** 2
    coefficients = back @ beta * scale[0]
    coefficients[0] += mean[0]
    both = fixed + ratio * variance + variance
    inflation = dict(zip(terms[1:], np.diag(np.linalg.inv(spread)), strict=True)) if p > 1 else {}
    # in y's own units the criterion shifts by the units' logarithm, and by that of the design's
    shift = (n - p) * (np.log(unit) + np.log(2 * np.pi) + 1) + 2 * np.log(scale[1:]).sum()
    return MixedModel(terms, coefficients, back @ covariance @ back.T * variance * unit, ratio * variance * unit, variance * unit, fixed / both, (fixed + ratio * variance) / both, inflation, criterion + float(shift), n, int(many.sum()))
