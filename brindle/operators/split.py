"""Train/test and fold assignment. A seed and the row's id decide, so reruns and other cluster sizes agree."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.checks import require_columns
from brindle.functions.expr import bin_of
from brindle.operators.relational import exact_quantiles, hash_cut, row_index, running_total

TRAIN, TEST = "Train", "Test"


def _key(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def bin_data(df: DataFrame, value: str, n_bins: int = 5, name: str = "Bin") -> DataFrame:
    """Bins 1..n_bins by exact inner quantiles; a value on an edge goes up."""
    edges = exact_quantiles(df, [], value, [i / n_bins for i in range(1, n_bins)], "_q")
    return df.crossJoin(F.broadcast(edges)).withColumn(name, bin_of(value, F.col("_q"))).drop("_q")


def collate_strata(df: DataFrame, columns: Sequence[str], name: str = "Bin", n_bins: int = 5) -> DataFrame:
    """One stratum text from several columns: texts and integers as they are, other numbers as their bin, joined by ':'."""
    require_columns(df, *columns)
    out, parts = df, []
    for i, c in enumerate(columns):
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out = bin_data(out, c, n_bins, f"_bin{i}")
            parts.append(F.col(f"_bin{i}").cast("string"))
        else:
            parts.append(F.col(c).cast("string"))
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(":"), p)
    return out.withColumn(name, joined).select(*[c for c in df.columns if c != name], name)


def random_split(df: DataFrame, fraction: float, id_col: str, seed: int = 42) -> DataFrame:
    """Set is Test for exactly floor(rows * fraction) ids, those with the least keyed hash.

    The hash of the last test id is the cut, so assignment is a comparison, not a join.
    """
    cut = hash_cut(df, id_col, int(df.count() * fraction), seed)
    return df.withColumn("Set", F.lit(TEST) if cut is None else F.when(cut, TEST).otherwise(TRAIN))


def stratified_split(df: DataFrame, fraction: float, strat_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """random_split() within each stratum."""
    dealt = _dealt(df, [strat_col], id_col, seed)
    sizes = df.groupBy(F.col(strat_col).alias("_s")).agg(F.floor(F.count("*") * F.lit(fraction)).alias("_n"))
    out = dealt.join(sizes, F.col(strat_col).eqNullSafe(F.col("_s")))
    return out.withColumn("Set", F.when(F.col("_rank") < F.col("_n"), TEST).otherwise(TRAIN)).drop("_rank", "_s", "_n")


def _dealt(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, slices: int = 64) -> DataFrame:
    """_rank: each row's 0-based place within its key by keyed hash. A key is ordered in slices of the hash, so that a frequent one spreads."""
    h = _key(id_col, seed)
    rows = df.withColumn("_h", h).withColumn("_slice", F.floor(F.shiftrightunsigned(h, 1) / F.lit(2.0**63 / slices)))
    counts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    for k in keys:
        heads = heads.withColumnRenamed(k, f"_k_{k}")
    heads = heads.withColumnRenamed("_slice", "_slice2")
    on = F.col("_slice") == F.col("_slice2")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    here = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_h", id_col)) - 1
    out = rows.withColumn("_here", here).join(heads, on)
    return out.withColumn("_rank", F.col("_here") + F.col("_before")).select(*df.columns, "_rank")


def random_folds(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """Fold 0..k-1; sizes differ by at most one."""
    placed = row_index(df.withColumn("_h", _key(id_col, seed)), "_h", id_col, name="_rank")
    return placed.withColumn("Fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank")


def stratified_folds(df: DataFrame, k: int, strat_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """Folds with equal shares of each stratum; each stratum starts at another fold, so that totals stay even."""
    dealt = _dealt(df, [strat_col], id_col, seed)
    return dealt.withColumn("Fold", F.pmod(F.col("_rank") + F.xxhash64(F.col(strat_col)), F.lit(k)).cast("int")).drop("_rank")


def group_folds(df: DataFrame, k: int, group_col: str, seed: int = 42) -> DataFrame:
    """Groups are never split: ordered by keyed hash and dealt in turn."""
    groups = df.select(group_col).distinct()
    placed = row_index(groups.withColumn("_h", _key(group_col, seed)), "_h", group_col, name="_rank")
    placed = placed.select(F.col(group_col).alias("_g"), (F.col("_rank") % k).cast("int").alias("Fold"))
    return df.join(placed, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def balanced_group_folds(df: DataFrame, k: int, group_col: str, strat_col: str | None = None, max_groups: int = 1_000_000) -> DataFrame:
    """Groups never split, folds even in size (and in each stratum): largest group first into the fold that is furthest behind.

    The greedy runs on the driver over group counts, which max_groups bounds.
    """
    keys = [group_col] + ([strat_col] if strat_col else [])
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if counts.select(group_col).distinct().count() > max_groups:
        raise ValueError(f"more than {max_groups} groups; use group_folds")
    sizes: dict = {}
    for r in counts.collect():
        sizes.setdefault(r[0], {})[r[1] if strat_col else None] = r["n"]
    order = sorted(sizes, key=lambda g: (-sum(sizes[g].values()), str(g)))
    totals: list[dict] = [{} for _ in range(k)]
    rows = []
    if strat_col is None:
        heap = [(0, f) for f in range(k)]
        for g in order:
            size, f = heapq.heappop(heap)
            heapq.heappush(heap, (size + sizes[g][None], f))
            rows.append((g, f))
    else:
        for g in order:
            def worst(f: int, g=g) -> tuple:
                after = {s: totals[f].get(s, 0) + n for s, n in sizes[g].items()}
                return (sum(v * v for v in after.values()) - sum(totals[f].get(s, 0) ** 2 for s in after), sum(totals[f].values()), f)

            f = min(range(k), key=worst)
            for s, n in sizes[g].items():
                totals[f][s] = totals[f].get(s, 0) + n
            rows.append((g, f))
    kind = df.schema[group_col].dataType
    placed = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_g", kind), T.StructField("Fold", T.IntegerType())]))
    return df.join(placed, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def minimal_split(df: DataFrame, fraction: float, cluster_col: str, tolerance: float = 0.05) -> DataFrame | None:
    """Whole clusters to Test, smallest first, while the running size before them is under ceil(rows * fraction).

    Ties in size go to the smaller key. None if the test set then exceeds ceil(rows * (fraction + tolerance)).
    """
    sizes = df.groupBy(cluster_col).agg(F.count("*").alias("_n"))
    total = df.count()
    placed = running_total(sizes, [], ["_n", cluster_col], "_n", "_before")
    chosen = placed.where(F.col("_before") < math.ceil(total * fraction))
    got = chosen.agg(F.sum("_n")).first()[0]
    if got is None or got > math.ceil(total * (fraction + tolerance)):
        return None
    test = chosen.select(F.col(cluster_col).alias("_c"), F.lit(TEST).alias("_s"))
    return df.join(test, F.col(cluster_col) == F.col("_c"), "left").withColumn("Set", F.coalesce("_s", F.lit(TRAIN))).drop("_c", "_s")


def temporal_split(df: DataFrame, time_col: str, fraction: float = 0.2) -> DataFrame:
    """Set is Test from the time at place round(rows * fraction), latest first, on; ties go to Test. Null times are Train.

    At a fraction whose place is past the last row, every row with a time is Test. Only distinct times are ordered.
    """
    n = round(df.count() * fraction)
    times = df.groupBy(F.col(time_col).alias("_t")).agg(F.count("*").alias("_c")).where("_t IS NOT NULL")
    late = running_total(times, [], [F.desc("_t")], "_c", "_later").where(F.col("_later") <= n)
    cut = late.agg(F.min("_t").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("Set", F.when(F.col(time_col) >= F.col("_cut"), TEST).otherwise(TRAIN)).drop("_cut")


def fold_balance(df: DataFrame, fold_col: str = "Fold", tolerance: float = 0.3) -> DataFrame:
    """(deviation, balanced): sample deviation over mean of the fold sizes, and whether it is within tolerance."""
    sizes = df.groupBy(fold_col).agg(F.count("*").alias("n"))
    deviation = F.coalesce(F.stddev_samp("n"), F.lit(0.0)) / F.avg("n")
    return sizes.agg(deviation.alias("deviation"), (deviation <= tolerance).alias("balanced"))


def batches(df: DataFrame, n: int, *order: str, name: str = "Batch") -> DataFrame:
    """Contiguous batches in the given order whose sizes differ by at most one."""
    total = df.count()
    small, extra = divmod(total, n)
    placed = row_index(df, *order, name="_rank")
    edge = extra * (small + 1)
    number = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (small + 1))).otherwise(extra + F.floor((F.col("_rank") - edge) / max(small, 1)))
    return placed.withColumn(name, (number + 1).cast("int")).drop("_rank")


class Folds:
    """Views of a table with a fold column. Train for a fold is everything but it and the test fold."""

    def __init__(self, df: DataFrame, fold_col: str = "Fold", test_fold: int | None = None) -> None:
        require_columns(df, fold_col)
        self.df, self.fold_col, self.test_fold = df, fold_col, test_fold

    def _allowed(self, fold: int) -> None:
        if fold == self.test_fold:
            raise ValueError("the test fold cannot be evaluated on")

    def train(self, fold: int) -> DataFrame:
        self._allowed(fold)
        out = self.df.where(F.col(self.fold_col) != fold)
        return out if self.test_fold is None else out.where(F.col(self.fold_col) != self.test_fold)

    def evaluation(self, fold: int) -> DataFrame:
        self._allowed(fold)
        return self.df.where(F.col(self.fold_col) == fold)

    def test(self) -> DataFrame:
        if self.test_fold is None:
            raise ValueError("there is no test fold")
        return self.df.where(F.col(self.fold_col) == self.test_fold)

    def development(self) -> DataFrame:
        return self.df if self.test_fold is None else self.df.where(F.col(self.fold_col) != self.test_fold)


class TrainTest:
    """Views of a table with a Set column."""

    def __init__(self, df: DataFrame, set_col: str = "Set") -> None:
        require_columns(df, set_col)
        self.df, self.set_col = df, set_col

    def train(self) -> DataFrame:
        return self.df.where(F.col(self.set_col) == TRAIN)

    def test(self) -> DataFrame:
        return self.df.where(F.col(self.set_col) == TEST)


def cluster_folds(df: DataFrame, k: int, cluster_col: str, strat_col: str | None = None, tolerance: float = 0.3) -> DataFrame:
    """Folds that split no cluster, even in size (and in each stratum); a RuntimeError if their sizes' relative deviation is over tolerance.

    cluster_col holds any clustering: scaffolds, greedy neighbourhoods, components (operators.cluster).
    """
    out = balanced_group_folds(df, k, cluster_col, strat_col)
    got = fold_balance(out, tolerance=tolerance).first()
    if not got["balanced"]:
        raise RuntimeError(f"folds are not balanced: a deviation of {got['deviation']:.3f}, with {tolerance} allowed")
    return out


def _clustered_folds(df: DataFrame, k: int, structure: str, labels: DataFrame, strat_col: str | None, tolerance: float) -> DataFrame:
    found = labels.select(F.col(structure).alias("_s"), "Cluster")
    return cluster_folds(df.join(found, F.col(structure) == F.col("_s")).drop("_s"), k, "Cluster", strat_col, tolerance)


def butina_folds(df: DataFrame, k: int, structure: str, vector: str, threshold: float = 0.4, metric: str = "jaccard", strat_col: str | None = None, tolerance: float = 0.3) -> DataFrame:
    """cluster_folds() by greedy neighbourhoods of the distinct structures."""
    from brindle.operators.cluster import butina_cluster

    once = df.groupBy(structure).agg(F.first(vector).alias(vector))
    return _clustered_folds(df, k, structure, butina_cluster(once, structure, vector, threshold, metric), strat_col, tolerance)


def component_folds(df: DataFrame, k: int, structure: str, vector: str, threshold: float = 0.3, metric: str = "jaccard", strat_col: str | None = None, tolerance: float = 0.3) -> DataFrame:
    """cluster_folds() by connected components of the distinct structures."""
    from brindle.operators.cluster import component_cluster

    once = df.groupBy(structure).agg(F.first(vector).alias(vector))
    return _clustered_folds(df, k, structure, component_cluster(once, structure, vector, threshold, metric), strat_col, tolerance)


def scaffold_folds(df: DataFrame, k: int, structure: str, scaffold: Column, strat_col: str | None = None, tolerance: float = 0.3) -> DataFrame:
    """cluster_folds() by the value of scaffold, an expression of the structure (a provider's kernel), computed once a structure."""
    from brindle.operators.cluster import label_values

    once = df.select(structure).distinct().withColumn("_scaffold", scaffold)
    return _clustered_folds(df, k, structure, label_values(once, "_scaffold"), strat_col, tolerance)
