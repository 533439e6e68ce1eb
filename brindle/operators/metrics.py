"""Evaluation of predictions: classification, regression, calibration, masked losses, ensembles; overall and by group.

Everything is one or two aggregations. Curve metrics aggregate to distinct scores first, and prefix sums over these run
within each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.expr import round_significant, safe_div
from brindle.operators.relational import exact_quantiles, running_total
from brindle.sources.tables import settle

DIGITS = 5
OVERALL = "Overall"
#: So many groups' means are sent to all tasks; more are joined.
FEW_GROUPS = 10_000


def _with_group(df: DataFrame, group: str | None) -> DataFrame:
    """Rows twice if there is a group: once for Overall, once for their own."""
    if group is None:
        return df.withColumn("Group", F.lit(OVERALL))
    return df.withColumn("Group", F.explode(F.array(F.lit(OVERALL), F.col(group).cast("string"))))


def _long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.unpivot(["Group"], list(names), "Metric", "Value").select("Metric", round_significant("Value", DIGITS).alias("Value"), "Group")


def curves(df: DataFrame, y: str, score: str, weight: Column) -> DataFrame:
    """(Group, roc, prc): areas under the ROC curve (ties count half) and under the precision steps."""
    points = df.groupBy("Group", F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 0, weight).otherwise(0.0)).alias("n"))
    both = running_total(points, ["Group"], [F.desc("s")], F.col("p"), "tp")
    both = running_total(both, ["Group"], [F.desc("s")], F.col("n"), "fp")
    cum = both.withColumn("tp", F.col("tp") + F.col("p")).withColumn("fp", F.col("fp") + F.col("n"))
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    steps = F.sum(F.col("p") * safe_div(F.col("tp"), F.col("tp") + F.col("fp")))
    return cum.groupBy("Group").agg(safe_div(area, F.sum("p") * F.sum("n")).alias("roc"), safe_div(steps, F.sum("p")).alias("prc"))


def linear_edges(n_bins: int) -> list[float]:
    """n_bins + 1 edges from 0 to 1, each i * (1 / n_bins) in floating point."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def calibration_bins(df: DataFrame, y: str, score: str, weight: Column, n_bins: int = 10) -> DataFrame:
    """(Group, bin, w, hit, mean): the weight, the share of positives and the mean score in [edge, next edge); 1.0 is in the last."""
    edges = F.array(*map(F.lit, linear_edges(n_bins)))
    place = F.least(F.size(F.filter(edges, lambda e: F.col(score) >= e)), F.lit(n_bins)) - 1
    rows = df.groupBy("Group", place.alias("bin")).agg(F.sum(weight).alias("w"), F.sum(weight * F.col(y)).alias("wy"), F.sum(weight * F.col(score)).alias("ws"))
    return rows.select("Group", "bin", "w", safe_div(F.col("wy"), F.col("w")).alias("hit"), safe_div(F.col("ws"), F.col("w")).alias("mean"))


def calibration_error(df: DataFrame, y: str, score: str, weight: Column, n_bins: int = 10) -> DataFrame:
    bins = calibration_bins(df, y, score, weight, n_bins)
    return bins.groupBy("Group").agg(safe_div(F.sum(F.col("w") * F.abs(F.col("hit") - F.col("mean"))), F.sum("w")).alias("ece"))


CLASSIFICATION = ("TP", "FP", "FN", "TN", "Accuracy", "Recall", "Specificity", "Precision", "Balanced Accuracy", "GeomRS", "HarmRS", "F1", "MCC", "ROC AUC", "PRC AUC", "Brier", "ECE")


def classification_metrics(df: DataFrame, y: str, score: str, label: str | None = None, weight: str | None = None, group: str | None = None, cut: float = 0.5) -> DataFrame:
    """(Metric, Value, Group) to five significant digits; groups whose labels are not exactly 0 and 1 give no rows.

    label is the predicted class; without it, score >= cut.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = _with_group(df, group).withColumn("_l", F.col(label) if label else (F.col(score) >= cut).cast("int"))
    yes, hit = F.col(y) == 1, F.col("_l") == 1
    part = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    cells = rows.groupBy("Group").agg(
        part(yes & hit).alias("TP"), part(~yes & hit).alias("FP"), part(yes & ~hit).alias("FN"), part(~yes & ~hit).alias("TN"),
        safe_div(F.sum(w * (F.col(score) - F.col(y)) * (F.col(score) - F.col(y))), F.sum(w)).alias("Brier"), F.count_distinct(y).alias("_k"),
    ).where("_k = 2")
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    recall, spec = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    wide = cells.join(curves(rows, y, score, w), "Group").join(calibration_error(rows, y, score, w), "Group").select(
        "Group", "TP", "FP", "FN", "TN", safe_div(tp + tn, tp + fp + fn + tn).alias("Accuracy"), recall.alias("Recall"), spec.alias("Specificity"),
        safe_div(tp, tp + fp).alias("Precision"), ((recall + spec) / 2).alias("Balanced Accuracy"), F.sqrt(recall * spec).alias("GeomRS"),
        safe_div(2 * recall * spec, recall + spec).alias("HarmRS"), safe_div(2 * tp, 2 * tp + fp + fn).alias("F1"),
        F.coalesce(safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("MCC"),
        F.col("roc").alias("ROC AUC"), F.col("prc").alias("PRC AUC"), "Brier", F.col("ece").alias("ECE"),
    )
    return _long(wide, CLASSIFICATION)


def regression_metrics(df: DataFrame, y: str, prediction: str, weight: str | None = None, group: str | None = None) -> DataFrame:
    """(Metric, Value, Group): weighted R2, MAE and RMSE.

    Rows are not moved to their group: means, one row a group, come to them, and what is left of a partition is a row a group.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = F.col(group).cast("string") if group is not None else F.lit(None).cast("string")
    rows = df.select(own.alias("_g"), w.alias("_w"), F.col(y).cast("double").alias("_t"), (F.col(prediction) - F.col(y)).cast("double").alias("_e"))
    sums = settle(rows.groupBy("_g").agg(F.sum(F.col("_w") * F.col("_t")).alias("_wt"), F.sum("_w").alias("_sw")))
    every = sums.agg(safe_div(F.sum("_wt"), F.sum("_sw")).alias("_all"))
    means = sums.where("_g IS NOT NULL").select(F.col("_g").alias("_k"), safe_div(F.col("_wt"), F.col("_sw")).alias("_mean"))
    few = sums.count() <= FEW_GROUPS
    near = rows.crossJoin(F.broadcast(every)).join(F.broadcast(means) if few else means, F.col("_g") == F.col("_k"), "left")
    both = [F.struct(F.lit(OVERALL).alias("Group"), F.col("_all").alias("m"))] + ([F.struct(F.col("_g").alias("Group"), F.col("_mean").alias("m"))] if group is not None else [])
    near = near.select("_w", "_t", "_e", F.explode(F.array(*both)).alias("_b")).select("_w", "_e", (F.col("_t") - F.col("_b.m")).alias("_off"), F.col("_b.Group").alias("Group")).where("Group IS NOT NULL")
    w, e, off = F.col("_w"), F.col("_e"), F.col("_off")
    wide = near.groupBy("Group").agg(
        (1 - safe_div(F.sum(w * e * e), F.sum(w * off * off))).alias("R2"), safe_div(F.sum(w * F.abs(e)), F.sum(w)).alias("MAE"), F.sqrt(safe_div(F.sum(w * e * e), F.sum(w))).alias("RMSE"),
    )
    return _long(wide, ("R2", "MAE", "RMSE"))


def masked_tasks(df: DataFrame, y: str, prediction: str, weight: str | None = None) -> DataFrame:
    """(row's columns, task, y, p, w): the tasks of array columns; entries with a missing value or no weight are left out."""
    arrays = [F.col(y), F.col(prediction)] + ([F.col(weight)] if weight else [])
    rows = df.select(*[c for c in df.columns if c not in (y, prediction, weight)], F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("y", "p", "w"), strict=False)])).alias("task", "_t"))
    out = rows.select(*[c for c in rows.columns if c != "_t"], F.col("_t.y").cast("double").alias("y"), F.col("_t.p").cast("double").alias("p"), (F.col("_t.w") if weight else F.lit(1.0)).cast("double").alias("w"))
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out.where(ok("y") & ok("p") & ok("w") & (F.col("w") > 0))


def masked_loss(tasks: DataFrame, loss: str = "squared", tags: str | None = None) -> DataFrame:
    """(Scope, Name, loss_sum, weight_sum, loss): Total, by Task, and by Group tag; a row counts for each of its tags.

    Sums add over batches; the loss is their quotient.
    """
    p, y = F.col("p"), F.col("y")
    kinds = {
        "squared": lambda: (p - y) * (p - y),
        "absolute": lambda: F.abs(p - y),
        "logistic": lambda: F.greatest(p, F.lit(0.0)) - p * y + F.log1p(F.exp(-F.abs(p))),
    }
    each = kinds[loss]() * F.col("w")
    sums = [F.sum(each).alias("loss_sum"), F.sum("w").alias("weight_sum")]
    by_task = tasks.groupBy("task").agg(*sums)
    out = by_task.agg(F.sum("loss_sum").alias("loss_sum"), F.sum("weight_sum").alias("weight_sum")).select(F.lit("Total").alias("Scope"), F.lit("Total").alias("Name"), "loss_sum", "weight_sum")
    out = out.unionByName(by_task.select(F.lit("Task").alias("Scope"), F.col("task").cast("string").alias("Name"), "loss_sum", "weight_sum"))
    if tags is not None:
        many = F.explode(tags) if dict(tasks.dtypes)[tags].startswith("array") else F.col(tags)
        out = out.unionByName(tasks.select(many.alias("Name"), "p", "y", "w").groupBy("Name").agg(*sums).select(F.lit("Group").alias("Scope"), F.col("Name").cast("string"), "loss_sum", "weight_sum"))
    return out.withColumn("loss", safe_div(F.col("loss_sum"), F.col("weight_sum")))


def vote(predictions: DataFrame, row: str, value: str, how: str, weights: DataFrame | None = None, unit: str = "unit") -> DataFrame:
    """(row, value) from the units' predictions: mode (smallest on ties), median, mean, or weighted by (unit, weight).

    Weights are not negative, finite and not all 0; they need not add up to 1.
    """
    if how == "mode":
        return predictions.groupBy(row).agg(F.mode(value, deterministic=True).alias(value))
    if how == "median":
        middles = exact_quantiles(predictions, [row], value, [0.5], "_q").withColumnRenamed(row, "_r")
        return predictions.select(row).distinct().join(middles, F.col(row).eqNullSafe(F.col("_r")), "left").select(row, F.get("_q", F.lit(0)).alias(value))
    if how == "mean":
        return predictions.groupBy(row).agg(F.avg(value).alias(value))
    if how != "weighted" or weights is None:
        raise ValueError("how is mode, median, mean, or weighted with weights")
    bad = weights.agg(F.count(F.when(F.col("weight").isNull() | F.isnan(F.col("weight").cast("double")) | (F.col("weight") < 0), 1)), F.sum("weight")).first()
    if bad[0] or not bad[1] or bad[1] == float("inf"):
        raise ValueError("weights must be finite, not negative, and not all 0")
    both = predictions.join(weights.select(F.col("unit").alias(unit), F.col("weight").alias("_w")), unit)
    return both.groupBy(row).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def aggregate_metrics(metrics: DataFrame, keys: Sequence[str] = ("Set", "Metric", "Group")) -> DataFrame:
    """mean, std (sample), min, max and median of Value over folds."""
    from brindle.operators.relational import summary_by

    return summary_by(metrics, keys, "Value")


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, share): the share of rows not above each distinct value, by keys."""
    points = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = points.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    cum = running_total(points, keys, [value], "_n", "_c").withColumn("_c", F.col("_c") + F.col("_n"))
    return cum.join(total, list(keys)).select(*keys, value, (F.col("_c") / F.col("_total")).alias("share"))


def histogram(df: DataFrame, value: str, n_bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): counts in n_bins equal intervals from the least to the greatest value, which is in the last; empty bins are there."""
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("_a"), F.max(v).alias("_z"))
    place = F.when(F.col("_z") > F.col("_a"), F.least(F.floor((v - F.col("_a")) / (F.col("_z") - F.col("_a")) * n_bins), F.lit(n_bins - 1))).otherwise(0)
    counts = df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda i: F.col("_a") + (F.col("_z") - F.col("_a")) * i / n_bins
    bins = ends.select("_a", "_z", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def quantile_pairs(df: DataFrame, a: str, b: str, points: int = 100) -> DataFrame:
    """(prob, a, b): the same quantiles of two columns side by side, points + 1 of them."""
    from brindle.operators.relational import quantiles

    probs = [i / points for i in range(points + 1)]
    one, two = (quantiles(df, c, probs).withColumnRenamed("quantile", n) for c, n in ((a, "a"), (b, "b")))
    return one.join(two, "prob")


def residuals(df: DataFrame, y: str, prediction: str, *keep: str) -> DataFrame:
    """keep, and residual (prediction less observation), its absolute value, and the residual over the sample deviation of all (0 where they do not vary)."""
    rows = df.select(*keep, (F.col(prediction) - F.col(y)).cast("double").alias("residual"))
    spread = rows.agg(F.stddev_samp("residual").alias("_s"))
    out = rows.crossJoin(F.broadcast(spread))
    return out.select(*keep, "residual", F.abs("residual").alias("absolute"), F.coalesce(safe_div(F.col("residual"), F.col("_s")), F.lit(0.0)).alias("standardized"))
