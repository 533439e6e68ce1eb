"""Repeated measurements of one key: agreement ranges, median-absolute-deviation outliers, censored values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.checks import require_columns
from brindle.operators.relational import exact_quantiles, keep_first
from brindle.sources.tables import settle

#: Keys with more values are worked on by aggregates and joins, not in one task; rounds of outliers that such keys may take.
HOT_ROWS = 200_000
MOST_ROUNDS = 200
#: A modified z-score is this times the distance from the median over the median absolute deviation.
Z_FACTOR = 0.6745


def unit_errors(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, unit_error) for every key: whether two of its values differ by exactly 3, 6 or 9.

    Values are joined to their shifted copies by equality, so no key's values are gathered.
    """
    seen = df.select(key, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").distinct()
    shifted = seen.select(key, F.explode(F.array(*[F.col("_v") + d for d in (3.0, 6.0, 9.0)])).alias("_v"))
    hit = shifted.join(seen, [key, "_v"], "left_semi").select(key).distinct().withColumn("_hit", F.lit(True))
    return df.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("unit_error"))


def consensus(values: np.ndarray, value_range: float, z: float, rounds: int | None = None) -> float | None:
    """The mean of the values once they agree within value_range, dropping outliers round by round; None if they never do, or not in so many rounds."""
    kept = _agreeing(values, value_range, z, rounds)
    return float(kept.mean()) if kept is not None and len(kept) else None


def mad_values(df: DataFrame, key: str, value: str, value_range: float = 1.0, z: float = 3.5, hot_rows: int = HOT_ROWS, rounds: int | None = None) -> DataFrame:
    """(key, value): one agreed value for each non-null key; a key with a single value keeps it. Rounds end with agreement, or after so many.

    Keys whose values agree at once, which are most, are settled by one aggregate in the JVM; only the others go
    through the rounds, a key at a time, and those with more than hot_rows values by mad_rounds(), as
    they may exceed a task's memory. The result is the same.
    """
    require_columns(df, key, value)
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    whole = rows.groupBy("k").agg(F.avg("v").alias("mean"), (F.max("v") - F.min("v") <= value_range).alias("agree"))
    easy = whole.where("agree").select("k", F.col("mean").alias("v"))
    hard = rows.join(whole.where(~F.col("agree")).select("k"), "k", "left_semi")
    if hot := _hot(hard, hot_rows):
        easy = easy.unionByName(mad_rounds(hard.join(hot, "k", "left_semi"), "k", "v", MOST_ROUNDS if rounds is None else rounds, value_range, z, hot_rows=0))
        hard = hard.join(hot, "k", "left_anti")

    kind = df.schema[key].dataType.simpleString()

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            got = [consensus(flat[i:j], value_range, z, rounds) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["k", "v"])

    # an aggregate, as only that is sure to bring a key's values together: plans may drop or cut a repartition
    done = hard.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs")).mapInArrow(agreed, f"k {kind}, v double")
    return easy.unionByName(done).select(F.col("k").alias(key), F.col("v").alias(value))


def mad_duplicates(df: DataFrame, key: str, value: str, value_range: float = 1.0, z: float = 3.5, rounds: int | None = None) -> DataFrame:
    """All rows of df, the value replaced by its key's agreed one; keys that never agree, and null keys, get null."""
    found = mad_values(df, key, value, value_range, z, rounds=rounds).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = df.join(found, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.col("_v").alias(c) if c == value else F.col(c) for c in df.columns])


def _agreed_rows(rows: DataFrame, rounds: int, value_range: float, z: float) -> tuple[DataFrame, DataFrame]:
    """(the rows (k, v) that are left once their key's values agree, the keys (k) whose values do not) after at most `rounds` relational rounds."""
    rows = settle(rows)
    agreed, failed = rows.where("false"), rows.where("false").select("k")
    for left in range(rounds, -1, -1):
        whole = settle(rows.groupBy("k").agg((F.max("v") - F.min("v") > value_range).alias("wide")))
        agreed = agreed.unionByName(rows.join(whole.where("NOT wide").select("k"), "k", "left_semi"))
        wide = settle(rows.join(whole.where("wide").select("k"), "k", "left_semi"))
        if not left or wide.isEmpty():
            return agreed, failed.unionByName(wide.select("k").distinct())
        off = F.abs(F.col("v") - F.get("q", F.lit(0)))
        near = settle(wide.join(exact_quantiles(wide, ["k"], "v", [0.5]), "k").select("k", "v", off.alias("off")))
        mads = exact_quantiles(near, ["k"], "off", [0.5], "mad")
        far = F.coalesce(Z_FACTOR * F.try_divide(F.col("off"), F.get("mad", F.lit(0))) > z, F.lit(False))
        judged = settle(near.join(mads, "k").select("k", "v", far.alias("far")))
        moved = judged.where("far").select("k").distinct()
        failed = failed.unionByName(judged.join(moved, "k", "left_anti").select("k").distinct())
        rows = judged.join(moved, "k", "left_semi").where("NOT far").select("k", "v")
    raise AssertionError("rounds is not negative")


def mad_rounds(df: DataFrame, key: str, value: str, rounds: int, value_range: float = 1.0, z: float = 3.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """mad_values() as at most `rounds` rounds in the JVM alone.

    A key's values are brought together once, in order, and all its rounds are expressions over that array. Keys with more
    than hot_rows values, which may exceed a task's memory, go through relational rounds instead: nothing but aggregates and
    joins. Each such round's rows are settled, so that a round reads a table and not all rounds before it; keys that agree,
    and keys that lost no value, leave; the rounds end when no key is left. The result is the same.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    parts = []
    hot = _hot(rows, hot_rows) if hot_rows else None
    if hot is not None or not hot_rows:
        agreed, failed = _agreed_rows(rows if hot is None else rows.join(hot, "k", "left_semi"), rounds, value_range, z)
        parts += [agreed.groupBy("k").agg(F.avg("v").alias("v")), failed.select("k", F.lit(None).cast("double").alias("v"))]
    if hot_rows:
        few = rows if hot is None else rows.join(hot, "k", "left_anti")
        kept = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("vs"), lambda vs, _: _round(vs, value_range, z)) if rounds else F.col("vs")
        left = few.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs")).select("k", kept.alias("vs"))
        mean = F.aggregate("vs", F.lit(0.0), lambda t, x: t + x) / F.size("vs")
        parts.append(left.select("k", F.when(~_wide(F.col("vs"), value_range), mean).alias("v")))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done.select(F.col("k").alias(key), F.col("v").alias(value))


def _wide(vs: Column, value_range: float) -> Column:
    return F.get(vs, F.size(vs) - 1) - F.get(vs, F.lit(0)) > value_range


def _median(vs: Column) -> Column:
    low, high = (F.get(vs, f(F.size(vs) - 1)) for f in (lambda n: F.floor(n / 2).cast("int"), lambda n: F.ceil(n / 2).cast("int")))
    return low + (high - low) * F.when(F.size(vs) % 2 == 0, 0.5).otherwise(0.0)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it: a lambda's variable holds a value."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _round(vs: Column, value_range: float, z: float) -> Column:
    """The ordered values without one round's outliers; values that agree stay."""

    def without(m: Column) -> Column:
        off = F.array_sort(F.filter(F.transform(vs, lambda v: F.abs(v - m)), lambda o: ~F.isnan(o)))
        mad = _once(off, _median)
        return _once(mad, lambda d: F.filter(vs, lambda v: ~F.coalesce(Z_FACTOR * F.abs(v - m) / F.nullif(d, F.lit(0.0)) > z, F.lit(False))))

    return F.when(_wide(vs, value_range), _once(_median(vs), without)).otherwise(vs)


def _hot(rows: DataFrame, hot_rows: int) -> DataFrame | None:
    """The keys (k) with more than hot_rows rows, or None if there are none."""
    hot = settle(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("k"))
    return None if hot.isEmpty() else hot


def reconcile(exact: float | None, above: float | None, below: float | None, r: float) -> tuple[float | None, str | None]:
    """One value and relation from an agreed exact value, the highest lower bound and the lowest upper bound.

    A bound that contradicts the exact value by more than r voids both; one that contradicts it by less, or not at all,
    yields to it. Two bounds that leave an interval of r or less, or cross by under r / 2, give their midpoint.
    """
    if exact is not None:
        clash = (above is not None and above - exact > r) or (below is not None and exact - below > r)
        return (None, None) if clash else (exact, "=")
    if above is not None and below is not None:
        gap = below - above
        if 0 <= gap <= r or 0 < -gap < 0.5 * r:
            return (above + below) / 2, "="
        return None, None
    if above is not None:
        return above, ">"
    if below is not None:
        return below, "<"
    return None, None


def censored_values(df: DataFrame, key: str, value: str, relation: str, value_range: float = 1.0, z: float = 3.5, hot_rows: int = HOT_ROWS, rounds: int | None = None) -> DataFrame:
    """(key, value, relation) for each non-null key from values with relation =, < or >.

    Each relation's values are first freed of outliers: = gives their median, > their maximum, < their minimum. If the exact
    values never agree, the key has neither value nor relation. Any other relation is an error. Keys with more than hot_rows
    rows are freed of outliers in relational rounds, all others a key and relation at a time; the result
    is the same. Sides whose values agree at once, which are most, stay in the JVM. Rounds end with agreement, or after so many.
    """
    require_columns(df, key, value, relation)

    def of_side(values: np.ndarray, side: str) -> float | None:
        kept = _agreeing(values, value_range, z, rounds)
        return None if kept is None else float({"=": np.median, ">": np.max, "<": np.min}[side](kept))

    bad = F.raise_error(F.concat(F.lit("unknown relation: "), F.coalesce(F.col(relation), F.lit("null"))))
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.when(F.col(relation).isin("=", "<", ">"), F.col(relation)).otherwise(bad).alias("r"))
    kind = df.schema[key].dataType.simpleString()
    rows = rows.where("k IS NOT NULL AND v IS NOT NULL")
    hot = _hot(rows, hot_rows)
    few = rows if hot is None else rows.join(hot, "k", "left_anti")
    names = {"=": "exact", ">": "above", "<": "below"}
    whole = few.groupBy("k").agg(*[F.sort_array(F.collect_list(F.when(F.col("r") == r, F.col("v")))).alias(c) for r, c in names.items()])
    wide = lambda c: F.get(c, F.size(c) - 1) - F.get(c, F.lit(0)) > value_range
    middle = (F.get("exact", F.floor((F.size("exact") - 1) / 2).cast("int")) + F.get("exact", F.floor(F.size("exact") / 2).cast("int"))) / 2
    at_once = {"exact": middle, "above": F.get("above", F.size("above") - 1), "below": F.get("below", F.lit(0))}
    found = whole.select("k", *[F.when(~wide(c), x).alias(c) for c, x in at_once.items()], *[F.when(wide(c), F.col(c)).alias(f"{c}_wide") for c in at_once])

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            failed, sides = np.zeros(len(b), dtype=bool), []
            for r, c in names.items():
                value = b[c].to_numpy(dtype=np.float64, na_value=np.nan).copy()
                for i in np.flatnonzero(b[f"{c}_wide"].notna()):
                    got = of_side(np.asarray(b[f"{c}_wide"].iat[i]), r)
                    value[i] = np.nan if got is None else got
                    failed[i] |= r == "=" and got is None
                sides.append([None if x != x else x for x in value.tolist()])
            if "bad" in b:
                failed |= b["bad"].notna().to_numpy()
            got = [(None, None) if bad else reconcile(*s, value_range) for bad, *s in zip(failed.tolist(), *sides, strict=True)]
            yield pd.DataFrame({"k": b["k"], "v": pd.Series([g[0] for g in got], dtype="float64", index=b.index), "r": pd.Series([g[1] for g in got], dtype="object", index=b.index)})

    out = found.mapInPandas(judged, f"k {kind}, v double, r string")
    if hot is not None:
        sides = rows.join(hot, "k", "left_semi").select(F.struct("k", "r").alias("k"), "v")
        agreed, failed = _agreed_rows(sides, MOST_ROUNDS if rounds is None else rounds, value_range, z)
        side = lambda r: agreed.where(F.col("k.r") == r)
        found = hot.join(exact_quantiles(side("=").select("k.k", "v"), ["k"], "v", [0.5]).select("k", F.get("q", F.lit(0)).alias("exact")), "k", "left")
        found = found.join(side(">").groupBy("k.k").agg(F.max("v").alias("above")), "k", "left").join(side("<").groupBy("k.k").agg(F.min("v").alias("below")), "k", "left")
        found = found.join(failed.where("k.r = '='").select("k.k", F.lit(True).alias("bad")), "k", "left")
        found = found.withColumns({f"{c}_wide": F.lit(None).cast("array<double>") for c in at_once})
        out = out.unionByName(found.mapInPandas(judged, f"k {kind}, v double, r string"))
    return out.select(F.col("k").alias(key), F.col("v").alias(value), F.col("r").alias(relation))


def _middle(ordered: np.ndarray) -> float:
    return (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def _agreeing(values: np.ndarray, value_range: float, z: float, rounds: int | None = None) -> np.ndarray | None:
    """The values, in order, left once they agree within value_range; None if outlier rounds end before, or do not get there in so many."""
    values, done = np.sort(values), 0
    while len(values) and values[-1] - values[0] > value_range:
        off = np.abs(values - _middle(values))
        mad = _middle(np.sort(off))
        kept = values[Z_FACTOR * off / mad <= z] if mad else values
        if len(kept) == len(values) or done == rounds:
            return None
        values, done = kept, done + 1
    return values


def mean_within_std(df: DataFrame, key: str, value: str, order: str, std_factor: float = 0.7) -> DataFrame:
    """One row a key (the first by order): the mean of the values within median +/- std_factor * std. Single values stay."""
    middles = exact_quantiles(df, [key], value, [0.5]).select(key, F.get("q", F.lit(0)).alias("_m"))
    stats = df.groupBy(key).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    near = df.join(middles, key).join(stats, key).where(F.abs(F.col(value) - F.col("_m")) <= std_factor * F.col("_s"))
    means = near.groupBy(key).agg(F.avg(value).alias("_mean"))
    first = keep_first(near.select(*df.columns), [key], order)
    return first.join(means, key).select(*[F.col("_mean").alias(c) if c == value else F.col(c) for c in df.columns])




def outcome_tables(df: DataFrame, status: str, good: str, ids: Sequence[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose status is good, without the status; the ids and reason of all others): a cleaning step's result and its side table."""
    require_columns(df, status, reason, *ids)
    kept = F.coalesce(F.col(status) == good, F.lit(False))
    return df.where(kept).drop(status), df.where(~kept).select(*ids, F.coalesce(F.col(status), F.lit("missing")).alias(status), reason)


def duplicate_tables(df: DataFrame, key: str, value: str, value_range: float = 1.0, z: float = 3.5, rounds: int | None = None) -> dict[str, DataFrame]:
    """The side tables of a deduplication by key: unique (keys with one row, as they are), agreed (one row a repeated key
    whose values agree, with n_values) and failed (all rows of repeated keys that never agree). Null keys are in none."""
    rows = df.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(value).alias("n_values"), F.count("*").alias("_n"))
    unique = rows.join(counts.where("_n = 1").select(key), key, "left_semi")
    found = mad_values(rows, key, value, value_range, z, rounds=rounds).join(counts.where("_n > 1").select(key, "n_values"), key)
    agreed = found.where(F.col(value).isNotNull())
    failed = rows.join(counts.where("_n > 1").select(key), key, "left_semi").join(agreed.select(key), key, "left_anti")
    return {"unique": unique, "agreed": agreed, "failed": failed}
