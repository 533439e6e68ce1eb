"""Relational building blocks: dictionaries, marks, ranks, samples, reshapes. Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.checks import require_columns
from brindle.functions.expr import half_even, nan_to_null
from brindle.sources.tables import settle


#: A sketch of a key's values tells ranks within one in ACCURACY; brackets around quantiles are several times as wide.
ACCURACY = 10_000
BRACKET = 5 / ACCURACY


def row_index(df: DataFrame, *order: Column | str, name: str = "row_id") -> DataFrame:
    """A contiguous 0-based index in the order of unique keys.

    Rows are range-partitioned and numbered within partitions; partition sizes, one row a partition, give the offsets. No
    task sees more than its range. What is numbered is settled before sizes are taken: planned twice, the ranges would be
    sampled twice, and their bounds differ.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = settle(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_m", 33)).withColumn("_n", F.col("_m").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col("_part").alias("_p")).agg((F.max("_n") + 1).alias("_size")).withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_p", "_offset")), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_n") + F.col("_offset")).cast("long").alias(name))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column | str, name: str) -> DataFrame:
    """name: the sum of value over the rows of the same key that come before, in the order given, which is unique within a key.

    Like row_index(): a key, however frequent, is spread over range partitions, and one row a partition and key gives the
    sums before it. The ranges are settled, as they are there.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    value = F.col(value) if isinstance(value, str) else value
    ranged = settle(df.withColumn("_value", value).repartitionByRange(*map(F.col, keys), *cols).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_inside", F.sum("_value").over(here))
    sums = ranged.groupBy(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.sum("_sum").over(before)).drop("_sum")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    total = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return ranged.join(sums, on).select(*df.columns, total.alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): an array of exact quantiles, by linear interpolation, for each key; missing values are skipped.

    No buffer holds a key's values. A sketch brackets each quantile first; a second pass counts what is below the bracket and
    groups the few distinct values inside, among which the exact places are found. Keys with few values are their own bracket.
    """
    x = nan_to_null((F.col(value) if isinstance(value, str) else value).cast("double"))
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], x.alias("_x")).where("_x IS NOT NULL")
    own = [f"_k{i}" for i in range(len(keys))]
    edges = [p for q in probs for p in (max(0.0, q - BRACKET), min(1.0, q + BRACKET))]
    known = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", list(edges), ACCURACY).alias("_e"))
    few = F.col("_n") < ACCURACY
    one = lambda i: F.struct(F.lit(i).alias("i"), F.when(few, F.col("_lo")).otherwise(F.get("_e", F.lit(2 * i))).alias("lo"), F.when(few, F.col("_hi")).otherwise(F.get("_e", F.lit(2 * i + 1))).alias("hi"))
    known = known.select(*own, "_n", F.array(*map(one, range(len(probs)))).alias("_b"))
    if keys:
        on = F.lit(True)
        for k in own:
            on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
        met = rows.alias("r").join(known.alias("b"), on).select(*[F.col(f"r.{k}") for k in own], "_x", "_n", "_b")
    else:
        met = rows.crossJoin(F.broadcast(known))  # one row
    each = met.select(*own, "_x", "_n", F.explode("_b").alias("_p")).where("_x <= _p.hi")
    counts = each.groupBy(*own, "_n", F.col("_p.i").alias("_i"), F.when(F.col("_x") >= F.col("_p.lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    seen = F.sum("_c").over(Window.partitionBy(*own, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.get(F.array(*map(F.lit, map(float, probs))), F.col("_i"))
    at = lambda c: F.min(F.when((F.col("_seen") > c) & F.col("_v").isNotNull(), F.col("_v")))
    below = F.max(F.when(F.col("_v").isNull(), F.col("_c")))
    found = counts.withColumn("_seen", seen).withColumn("_at", place).groupBy(*own, "_i", "_at").agg(at(F.floor("_at")).alias("_a"), at(F.ceil("_at")).alias("_z"), F.coalesce(below, F.lit(0)).alias("_below"))
    sure = F.col("_z").isNotNull() & (F.col("_below") <= F.floor("_at"))
    exact = F.when(sure, F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).otherwise(F.raise_error(F.lit("a quantile is outside its bracket")).cast("double"))
    out = found.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_i", exact.alias("v")))).alias("_q"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.transform("_q", lambda q: q["v"]).alias(name))


def hash_cut(df: DataFrame, id_col: str, n: int, seed: int) -> Column | None:
    """A condition true for exactly the n rows with the least keyed hash of their unique id; None if there are no more than n.

    Counts by the hash's first 16 bits tell in which of 65,536 parts the cut lies; only that part is ordered.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    part = F.shiftright(h, 48).cast("int")
    before = 0
    for r in sorted(df.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()):
        if before + r["c"] > n:
            cut = df.where(part == r["p"]).select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").offset(n - before).limit(1).first()
            kind = df.schema[id_col].dataType
            return (h < cut["h"]) | ((h == cut["h"]) & (F.col(id_col) < F.lit(cut["i"]).cast(kind)))
        before += r["c"]
    return None


def with_dictionary_column(df: DataFrame, key: str, out: str, fn: Callable[[Column], Column]) -> DataFrame:
    """out = fn(key), computed once for each distinct key and joined back; null keys give null.

    The dictionary's size is not known, so the join's strategy is left to the planner, which broadcasts what is small.
    """
    require_columns(df, key)
    dim = df.select(key).where(F.col(key).isNotNull()).distinct().select(F.col(key).alias("_key"), fn(F.col(key)).alias(out))
    return df.drop(out).join(dim, F.col(key) == F.col("_key"), "left").drop("_key")


def mark_duplicates(df: DataFrame, keys: Sequence[str], name: str = "duplicated") -> DataFrame:
    """Marks every row whose key occurs more than once; null keys count as equal.

    Counts are aggregated and joined back, so a frequent key is never gathered in one task as a window would.
    """
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.count("*") > 1).alias(name))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(counts, on, "left").drop(*[f"_{k}" for k in keys])


def split_duplicates(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a unique key, rows with a repeated key)."""
    marked = mark_duplicates(df, keys, "_dup")
    return marked.where(~F.col("_dup")).drop("_dup"), marked.where("_dup").drop("_dup")


def keep_first(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key in the order given. min over structs combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and where it occurs (both, left_only, right_only); an error if either side repeats a key."""
    a = left.groupBy(key).agg(F.count("*").alias("_a"))
    b = right.groupBy(key).agg(F.count("*").alias("_b"))
    both = a.join(b, key, "full_outer")
    repeated = (F.coalesce("_a", F.lit(0)) > 1) | (F.coalesce("_b", F.lit(0)) > 1)
    where = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return both.select(key, F.when(repeated, F.raise_error(F.lit("the keys are not one to one"))).otherwise(where).alias("side"))


def summary_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, std (sample), min, max, median of value by keys."""
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return join_null_safe(plain, exact_quantiles(df, keys, value, [0.5], "_q"), keys).select(*keys, "mean", "std", "min", "max", F.get("_q", F.lit(0)).alias("median"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """left with right's other columns; null keys are equal."""
    right = right.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return left.join(right, on, how).drop(*[f"_on{i}" for i in range(len(keys))])


def count_and_mean(df: DataFrame, key: str, value: str, places: int = 5) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), half_even(F.avg(value), places).alias("mean"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("weighted_mean"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """(prob, quantile), exact, by linear interpolation; missing values are skipped."""
    found = exact_quantiles(df, [], value, probs)
    return found.select(F.posexplode("q").alias("i", "quantile")).select(F.get(F.array(*map(F.lit, probs)), F.col("i")).alias("prob"), "quantile")


def correlations(df: DataFrame, row_key: str, vector: str) -> DataFrame:
    """(a, b, r): absolute Pearson correlation of each pair of positions a < b of a vector column; 0 where it is undefined."""
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    spread = lambda q, s: F.col(q) - s * s / n
    top = F.col("sab") - sa * sb / n
    rest = F.when((spread("saa", sa) > 1e-13 * F.col("saa")) & (spread("sbb", sb) > 1e-13 * F.col("sbb")), F.sqrt(spread("saa", sa) * spread("sbb", sb)))
    return position_products(df, vector).where("a < b").select("a", "b", F.coalesce(F.abs(F.try_divide(top, rest)), F.lit(0.0)).alias("r"))


def position_products(df: DataFrame, vector: str) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for positions a <= b: the number of rows with both, and the sums of their values, squares and products.

    Values are less a first row's, so that sums of products keep their digits. Each partition adds its batches' Gram
    matrices up and gives one row a pair; a missing value counts for no pair. Vectors of another width than the first raise.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(v.alias("v")).where("v IS NOT NULL")
    first = rows.first()
    if first is None:
        return df.sparkSession.createDataFrame([], "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double")
    shift = np.array([0.0 if x is None or x != x else x for x in first["v"]])
    width = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width, width))
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != width * b.num_rows or (b.num_rows and np.diff(lists.offsets.to_numpy()).max() != width):
                raise ValueError(f"vectors must have {width} components")
            x = flat.reshape(-1, width) - shift
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            m = there.astype(np.float64)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        if sums[0].any():
            a, z = np.triu_indices(width)
            n, s, q, p = sums
            cols = [n[a, z], s[a, z], s[z, a], q[a, z], q[z, a], p[a, z]]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), *map(pa.array, cols)], names=["a", "b", *names])

    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    parts = rows.mapInArrow(run, "a int, b int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])


def mode_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value by keys, the smallest on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias("mode"))


def union_all(frames: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    """All rows; with missing, columns that a frame lacks are null there. Types widen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=missing)
    return out


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Spark cuts to k within each task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def item_at(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The row at 0-based place n of a unique order. A far place is found by its range partition, not by one task that holds n rows."""
    if n <= 100_000:
        return df.orderBy(*order).offset(n).limit(1)
    return row_index(df, *order, name="_place").where(F.col("_place") == n).drop("_place")


def sample_exact(df: DataFrame, id_col: str, fraction: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly floor(rows * fraction), or n, rows: those with the least keyed hash of their id."""
    size = n if n is not None else int(df.count() * fraction)
    cut = hash_cut(df, id_col, size, seed)
    return df if cut is None else df.where(cut)


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")
