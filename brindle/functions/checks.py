"""Plan-time checks of a table's columns; none of them runs a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require_columns(df, *names)
    for n in names:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise TypeError(f"{n} must be numeric, not {df.schema[n].dataType.simpleString()}")


def require_vector(df: DataFrame, name: str) -> None:
    require_columns(df, name)
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{name} must be an array of numbers, not {kind.simpleString()}")


#: What each role of a training table is called in batches.
ROLES = {"target": "y_true", "weight": "y_wgts"}


def validate_modalities(config: dict[str, str]) -> None:
    """config: column -> role. One target, at most one weight and one group, at least one feature."""
    roles = list(config.values())
    if roles.count("target") != 1:
        raise ValueError("exactly one column must be the target")
    for role in ("weight", "group"):
        if roles.count(role) > 1:
            raise ValueError(f"at most one column can be the {role}")
    if not [r for r in roles if r not in ("target", "weight", "group")]:
        raise ValueError("at least one column must be a feature")


def select_modalities(df: DataFrame, config: dict[str, str]) -> DataFrame:
    """The configured columns under their batch names."""
    validate_modalities(config)
    require_columns(df, *config)
    return df.select(*[df[c].alias(ROLES.get(r, c)) for c, r in config.items()])


def columns_in_common(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], list[str]]:
    """(in both, in a only), in a's order."""
    return [c for c in a if c in b], [c for c in a if c not in b]
