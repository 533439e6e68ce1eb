"""Closed-interval filters over numeric columns, and sequential outlier cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.checks import require_numeric

Bounds = Mapping[str, tuple[float, float]]

# Closed intervals that a plausible molecule's properties are in.
VALID_BOUNDS = {
    "MolWt": (32, 2048), "LogP": (-10, 12), "MolMR": (0, 512), "HeavyAtoms": (2, 128), "Heteroatoms": (0, 48),
    "TPSA": (0, 512), "HBA": (0, 24), "HBD": (0, 16), "RotatableBonds": (0, 32), "Rings": (0, 12),
}
# Closed intervals of common molecules.
COMMON_BOUNDS = {
    "MolWt": (32, 1024), "LogP": (-7, 11), "MolMR": (16, 288), "HeavyAtoms": (2, 80), "Heteroatoms": (0, 24),
    "TPSA": (0, 288), "HBA": (0, 16), "HBD": (0, 8), "RotatableBonds": (0, 20), "Rings": (0, 8),
}
# The eleven ranges of the outlier filter.
OUTLIER_BOUNDS = {
    "MolWt": (30, 1200), "MolLogP": (-7, 9), "MolMR": (0, 400), "TPSA": (0, 200), "NumHeavyAtom": (1, 100),
    "NumHAcceptors": (0, 24), "NumHDonors": (0, 12), "NumHeteroatoms": (0, 24), "NumRotatableBonds": (0, 32),
    "NumAliphaticRings": (0, 10), "NumAromaticRings": (0, 10),
}


def violations(bounds: Bounds) -> Column:
    """Texts 'name: value < lo' or 'name: value > hi', two decimals, joined by ' | '; empty if all bounds hold."""
    said = []
    for name, (lo, hi) in bounds.items():
        v = F.col(name)
        tell = lambda sign, limit, v=v, name=name: F.format_string(f"{name}: %.2f {sign} {limit}", v.cast("double"))
        said += [F.when(v < lo, tell("<", lo)), F.when(v > hi, tell(">", hi))]
    return F.array_join(F.array_compact(F.array(*said)), " | ")


def bounds_filter(df: DataFrame, bounds: Bounds) -> DataFrame:
    """The rows whose columns are all within their closed interval; a null fails. The tests reach the scan."""
    require_numeric(df, *bounds)
    for name, (lo, hi) in bounds.items():
        df = df.where(F.col(name).between(lo, hi))
    return df


def outlier_filter(df: DataFrame, **changes: tuple[float, float]) -> DataFrame:
    """bounds_filter() by OUTLIER_BOUNDS, with changed or further ranges by column name."""
    return bounds_filter(df, OUTLIER_BOUNDS | changes)


def bounds_flag(df: DataFrame, bounds: Bounds, name: str = "_property_violation") -> DataFrame:
    require_numeric(df, *bounds)
    return df.withColumn(name, violations(bounds))


def sigma_filter(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """Cuts rows beyond mean +/- k sample deviations, a column after the other: each cut sees what the one before left."""
    require_numeric(df, *columns)
    for c in columns:
        stats = df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
        df = df.join(F.broadcast(stats), F.abs(F.col(c) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")
    return df
