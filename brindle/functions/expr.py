"""Column expressions that every operator builds on. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """Missing numbers are null before any aggregate: NaN would sort above everything and poison means."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, b)


def half_even(c: Column | str, places: int) -> Column:
    """Round half to even."""
    return F.bround(_col(c), places)


def fixed(c: Column | str, places: int = 6) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: one rounding rule that every engine computes alike."""
    return F.floor(_col(c) * (10.0**places) + 0.5).cast("double") / (10.0**places)


def round_significant(c: Column | str, digits: int) -> Column:
    """digits significant digits, half to even. 0 and infinities stay, -0 becomes 0, null and NaN give null."""
    c = nan_to_null(_col(c).cast("double"))
    scale = F.pow(F.lit(10.0), digits - F.floor(F.log10(F.abs(c))) - 1)
    return F.when((c == 0) | (F.abs(c) == float("inf")), c + 0.0).otherwise(F.rint(c * scale) / scale)


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """c between lo and hi; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def strip_chars(c: Column | str, char: str) -> Column:
    """Without the leading and trailing characters char."""
    return F.btrim(_col(c), F.lit(char))


def contains_any(c: Column | str, parts: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the parts, literally."""
    low = F.lower(_col(c))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def join_text(sep: str, *cols: Column | str) -> Column:
    """The texts with sep between; null if any is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), _col(c)] if parts else [_col(c)]
    return F.concat(*parts)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def unit_error(values: Column) -> Column:
    """Whether two of an array's values differ by exactly 3, 6 or 9, as values in wrong units do on a log scale."""
    return F.exists(values, lambda v: F.exists(values, lambda w: (w == v + 3.0) | (w == v + 6.0) | (w == v + 9.0)))


def number_after_relation(c: Column | str) -> Column:
    """A struct of relation (<, > or =) and value from texts like '>10.5'; only a real prefix is cut, bad numbers are null."""
    text = F.trim(_col(c))
    mark = F.regexp_extract(text, r"^([<>]?)", 1)
    value = F.regexp_replace(text, r"^[<>]", "").try_cast("double")
    return F.struct(F.when(value.isNotNull(), F.when(mark == "", "=").otherwise(mark)).alias("relation"), value.alias("value"))


def one_hot(c: Column | str, levels: Sequence) -> Column:
    """An array of 0 and 1 over the levels; null is all zeros, an unknown value is an error."""
    c = _col(c)
    hot = F.array(*[F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in levels])
    known = c.isNull() | c.isin(list(levels))
    return F.when(known, hot).otherwise(F.raise_error(F.concat(F.lit("value outside the levels: "), c.cast("string"))))


def radial_basis(distance: Column | str, centers: Sequence[float], eta: float, cutoff: float | None = None) -> Column:
    """exp(-eta (d - c)^2) for each centre, times a cosine cutoff if one is given."""
    d = _col(distance)
    out = [F.exp(-eta * (d - c) * (d - c)) for c in centers]
    if cutoff is not None:
        fade = F.when(d < cutoff, 0.5 * (F.cos(d * (3.141592653589793 / cutoff)) + 1)).otherwise(0.0)
        out = [x * fade for x in out]
    return F.array(*out)


def bin_of(c: Column | str, inner_edges: Column) -> Column:
    """1 + the number of inner edges that are not above the value."""
    c = _col(c)
    return F.when(c.isNotNull(), 1 + F.size(F.filter(inner_edges, lambda e: c >= e)))


def sign_bits(vector: Column | str) -> Column:
    """The signs (> 0) of up to 63 components as one long."""
    return F.aggregate(_col(vector), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def binary_distance(a: Column, b: Column, n_bits: int, metric: str) -> Column:
    """1 - similarity of two bit sets in longs. Where a similarity is 0/0 it is 0."""
    na, nb, c = F.bit_count(a), F.bit_count(b), F.bit_count(a.bitwiseAND(b))
    d = n_bits - na - nb + c
    forms = {
        "jaccard": lambda: safe_div(c, na + nb - c),
        "tanimoto": lambda: safe_div(c, na + nb - c),
        "dice": lambda: safe_div(2 * c, na + nb),
        "braunblanquet": lambda: safe_div(c, F.greatest(na, nb)),
        "kulczynski": lambda: safe_div(c * (na + nb), 2 * na * nb),
        "mcconnaughey": lambda: safe_div(c * (na + nb) - na * nb, na * nb),
        "rogotgoldberg": lambda: F.coalesce(safe_div(c, na + nb), F.lit(0.0)) + F.coalesce(safe_div(d, 2 * n_bits - na - nb), F.lit(0.0)),
        "russel": lambda: c / n_bits,
        "sokal": lambda: safe_div(c, 2 * na + 2 * nb - 3 * c),
    }
    if metric not in forms:
        raise ValueError(f"no binary metric {metric!r}; there are {sorted(forms)}")
    return 1 - F.coalesce(forms[metric](), F.lit(0.0))


def vector_distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """The distance of two numeric arrays, in double precision."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "sqeuclidean":
        return total(lambda x, y: (x - y) * (x - y))
    if metric in ("cityblock", "manhattan"):
        return total(lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    if metric == "cosine":
        return 1 - safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "canberra":
        return total(lambda x, y: F.coalesce(safe_div(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))
    if metric == "braycurtis":
        return safe_div(total(lambda x, y: F.abs(x - y)), total(lambda x, y: F.abs(x + y)))
    if metric == "hamming":
        return safe_div(total(lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), F.size(a))
    raise ValueError(f"no metric {metric!r}")
