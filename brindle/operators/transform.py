"""Preprocessing of a numeric vector column: masks, clipping, imputation, selection, scaling. Fitted statistics are exact.

Statistics come from one grouped aggregation over (position, value); the fitted parameters are one row a position, so they
grow with the vector's width, not with the data, and are applied inside expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.checks import require_vector
from brindle.functions.expr import clip, nan_to_null
from brindle.operators.relational import correlations, exact_quantiles, position_products

# The standard normal quantiles of 5 % and 95 % are this far apart.
NORMAL_RANGE_5_95 = 3.289707253902945
MAX_MISSING = 0.05
MAX_ABS = 1e12
MIN_VARIANCE = 1e-3
MAX_CORRELATION = 0.9


def positions(df: DataFrame, vector: str) -> DataFrame:
    """(pos, x): every component, missing ones null."""
    return df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).withColumn("x", nan_to_null("x"))


def clip_limits(df: DataFrame, vector: str, method: str, low: float = 0.005, high: float = 0.995, k: float = 6.0) -> DataFrame:
    """(pos, lo, hi): limits by 'std' (mean +/- k population deviations), 'mad' (median +/- k median absolute deviations) or 'quantile'."""
    rows = positions(df, vector)
    if method == "std":
        return rows.groupBy("pos").agg((F.avg("x") - k * F.stddev_pop("x")).alias("lo"), (F.avg("x") + k * F.stddev_pop("x")).alias("hi"))
    if method == "quantile":
        return exact_quantiles(rows, ["pos"], "x", [low, high]).select("pos", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    if method == "mad":
        # one row a position, which grows with the width, not with the data
        med = exact_quantiles(rows, ["pos"], "x", [0.5]).select("pos", F.get("q", F.lit(0)).alias("m"))
        off = rows.join(F.broadcast(med), "pos").select("pos", F.abs(F.col("x") - F.col("m")).alias("d"))
        mad = exact_quantiles(off, ["pos"], "d", [0.5]).select("pos", F.get("q", F.lit(0)).alias("d"))
        return med.join(mad, "pos").select("pos", (F.col("m") - k * F.col("d")).alias("lo"), (F.col("m") + k * F.col("d")).alias("hi"))
    raise ValueError(f"no clipping method {method!r}")


def position_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row a position: missing share, largest magnitude, population variance, median, 5 % and 95 % quantile."""
    rows = positions(df, vector)
    plain = rows.groupBy("pos").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.max(F.abs("x")).alias("top"), F.var_pop("x").alias("variance"))
    q = exact_quantiles(rows, ["pos"], "x", [0.5, 0.05, 0.95])
    return plain.join(q, "pos", "left").select("pos", "missing", "top", "variance", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "q05", "q95"))])


def prune_correlated(pairs: Sequence[tuple[int, int, float]], kept: Sequence[int], limit: float = MAX_CORRELATION) -> list[int]:
    """Positions left after dropping, again and again, the one with most correlations >= limit (then the highest mean of these, rounded 5).

    Works on positions, not rows, so it runs on the driver.
    """
    alive = set(kept)
    near: dict[int, dict[int, float]] = {}
    for a, b, r in pairs:
        if r >= limit and a in alive and b in alive:
            near.setdefault(a, {})[b] = r
            near.setdefault(b, {})[a] = r
    while near:
        worst = max(near, key=lambda p: (len(near[p]), round(math.fsum(near[p].values()) / len(near[p]), 5), -p))
        alive.discard(worst)
        for p in near.pop(worst):
            del near[p][worst]
            if not near[p]:
                del near[p]
    return sorted(alive)


@dataclass
class VectorTransformer:
    """fit() learns, transform() applies, in this order: masks, clip, impute, select, prune correlated, scale.

    A second fit() needs reset(). transform() checks the vector's width. Every step can be switched off.
    """

    mask: bool = True
    clipping: tuple[float, float] | None = (0.01, 0.99)
    impute: bool = True
    min_variance: float | None = MIN_VARIANCE
    max_correlation: float | None = MAX_CORRELATION
    scale: bool = True
    params: dict = field(default_factory=dict)

    def reset(self) -> None:
        self.params = {}

    def fit(self, df: DataFrame, vector: str) -> VectorTransformer:
        if self.params:
            raise RuntimeError("already fitted; call reset() first")
        require_vector(df, vector)
        stats = {r["pos"]: r for r in position_stats(df, vector).collect()}
        if not stats:
            raise ValueError("no rows to fit on")
        width = max(stats) + 1
        kept = [p for p in range(width) if not self.mask or self._passes(stats[p])]
        lo, hi = [None] * width, [None] * width
        if self.clipping:
            for r in clip_limits(df, vector, "quantile", *self.clipping).collect():
                lo[r["pos"]], hi[r["pos"]] = r["lo"], r["hi"]
        self.params = {"width": width, "kept": kept, "lo": lo, "hi": hi, "fill": [None] * width, "center": [0.0] * width, "scale": [1.0] * width}
        again = {r["pos"]: r for r in position_stats(self._shaped(df, vector, "_v", kept), "_v").collect()}
        by = {p: again[i] for i, p in enumerate(kept)}
        for p in kept:
            self.params["fill"][p] = by[p]["median"] if self.impute else None
        if self.min_variance is not None:
            kept = [p for p in kept if (by[p]["variance"] or 0.0) > self.min_variance]
        if self.max_correlation is not None and len(kept) > 1:
            rows = correlations(self._shaped(df, vector, "_v", kept), "_v", "_v").collect()
            kept = prune_correlated([(kept[r["a"]], kept[r["b"]], r["r"]) for r in rows], kept, self.max_correlation)
        if not kept:
            raise ValueError("no feature is left")
        if self.scale:
            final = position_stats(self._shaped(df, vector, "_v", kept), "_v").collect()
            for r in final:
                p, spread = kept[r["pos"]], (r["q95"] - r["q05"]) / NORMAL_RANGE_5_95
                self.params["center"][p], self.params["scale"][p] = r["median"], spread or 1.0
        self.params["kept"] = kept
        return self

    @staticmethod
    def _passes(r) -> bool:
        return r["missing"] <= MAX_MISSING and r["top"] is not None and r["top"] <= MAX_ABS and (r["variance"] or 0.0) > 0

    def _shaped(self, df: DataFrame, vector: str, out: str, kept: Sequence[int]) -> DataFrame:
        """The kept positions' values, clipped, filled and scaled. The parameters are one constant array that a single
        expression walks, so the generated code does not grow with the width."""
        p, number = self.params, lambda x: F.lit(x).cast("double")
        steps = F.array(*[F.struct(F.lit(i).alias("i"), *[number(p[k][i]).alias(k) for k in ("lo", "hi", "fill", "center", "scale")]) for i in kept])

        def cell(s: Column) -> Column:
            x = nan_to_null(F.get(F.col(vector), s["i"]).cast("double"))
            x = F.when(s["lo"].isNull(), x).otherwise(clip(x, s["lo"], s["hi"]))
            return (F.coalesce(x, s["fill"]) - s["center"]) / s["scale"]

        return df.withColumn(out, F.transform(steps, cell))

    def transform(self, df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        if not self.params:
            raise RuntimeError("not fitted")
        require_vector(df, vector)
        width = self.params["width"]
        checked = F.when(F.size(vector) == width, F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors must have {width} components")))
        return self._shaped(df.withColumn("_checked", checked), "_checked", out or vector, self.params["kept"]).drop("_checked")

    def fit_transform(self, df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        return self.fit(df, vector).transform(df, vector, out)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> VectorTransformer:
        got = json.loads(text)
        got["clipping"] = tuple(got["clipping"]) if got["clipping"] else None
        return cls(**got)


#: Steps by kind of feature: binary and count vectors are neither clipped nor scaled.
KINDS = {"continuous": {}, "binary": {"clipping": None, "scale": False}, "integer": {"clipping": None, "scale": False}}
# The kind of each named feature.
NAMED = {
    "binary": "AtomPair Daylight ECFP MACCS Klek",
    "continuous": "Mordred CDDD ChemBERTa RDKit CDDD_internal MiniMol MiniLM Qwen3 MolEncoder",
    "integer": "MAP MAPC AtomPairCount DaylightCount ECFPCount",
}
PRESETS = KINDS | {name: KINDS[kind] for kind, names in NAMED.items() for name in names.split()}


def preset(kind: str) -> VectorTransformer:
    """A transformer for a kind of feature, or for one of the named features."""
    if kind not in PRESETS:
        raise KeyError(f"no preset {kind!r}; there are {sorted(PRESETS)}")
    return VectorTransformer(**PRESETS[kind])


def merge_vectors(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """The arrays one behind the other. Any floating type makes the result floating, as wide as the widest; signed wins over unsigned."""
    rank = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}
    kinds = []
    for c in columns:
        require_vector(df, c)
        kinds.append(df.schema[c].dataType.elementType.simpleString())
    top = max(kinds, key=lambda k: rank.get(k, 5))
    return df.withColumn(out, F.concat(*[F.col(c).cast(f"array<{top}>") for c in columns]))


def pca(df: DataFrame, vector: str, k: int, out: str, other: DataFrame | None = None) -> DataFrame:
    """other (or df) with the k principal components of df's vectors as out.

    The covariance comes from one Gram matrix a partition; the driver decomposes the sum, width x width. Vectors
    are centred on df's means. k is cut to the width. A component's sign makes its largest loading positive.
    """
    import numpy as np

    require_vector(df, vector)
    v = F.col(vector).cast("array<double>")
    means = [r["m"] for r in df.select(F.posexplode(v).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).orderBy("p").collect()]
    d = len(means)
    cov = np.zeros((d, d))
    for r in position_products(df, vector).collect():
        cov[r["a"], r["b"]] = cov[r["b"], r["a"]] = (r["sab"] - r["sa"] * r["sb"] / r["n"]) / r["n"] if r["n"] else 0.0
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)][:, : min(k, d)]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    cells = []
    for axis in axes.T:
        weights = F.array(*map(F.lit, axis.tolist()))
        shift = float(axis @ np.array(means))
        cells.append(F.aggregate(F.zip_with(v, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) - shift)
    return (other if other is not None else df).withColumn(out, F.array(*cells))

