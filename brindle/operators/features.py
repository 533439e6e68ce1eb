"""Per-row features: encodings, array merges, and a pluggable interface for kernels whose library may be absent."""

from __future__ import annotations

import importlib
import subprocess
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.checks import require_columns
from brindle.functions.expr import one_hot
from brindle.sources.tables import settle


#: Levels of a column that one_hot_columns() finds by itself; each is an element of every row's array.
MOST_LEVELS = 10_000
#: Nearest nodes are looked for in cells of at most about CROWD nodes; cells are halved up to DEPTH times.
CROWD = 16
DEPTH = 10


def one_hot_columns(df: DataFrame, columns: Sequence[str], out: str, levels: dict[str, Sequence] | None = None) -> DataFrame:
    """One array of 0 and 1 over the sorted distinct levels of each column, one behind the other; more than MOST_LEVELS are an error."""
    require_columns(df, *columns)
    found = levels or {c: [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(MOST_LEVELS + 1).collect()] for c in columns}
    for c, of in found.items():
        if levels is None and len(of) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels; name those that count")
    return df.withColumn(out, F.concat(*[one_hot(c, found[c]) for c in columns]))


def radial_sums(edges: DataFrame, target: str, distance: str, centers: Sequence[float], eta: float, cutoff: float) -> DataFrame:
    """(target, features): radial basis values summed over each node's edges. Coincident nodes are an error."""
    d = F.when(F.col(distance) > 0, F.col(distance)).otherwise(F.raise_error(F.lit("coincident nodes")))
    fade = F.when(d < cutoff, 0.5 * (F.cos(d * (3.141592653589793 / cutoff)) + 1)).otherwise(0.0)
    sums = [F.sum(F.exp(-eta * (d - c) * (d - c)) * fade) for c in centers]
    return edges.groupBy(target).agg(F.array(*sums).alias("features"))


def angular_sums(edges: DataFrame, target: str, source: str, vector: str, centers: Sequence[float], eta: float) -> DataFrame:
    """(target, features): Gaussian values of the angle between each unordered pair of a node's edge vectors, summed."""
    a = edges.select(F.col(target).alias("t"), F.col(source).alias("s1"), F.col(vector).alias("v1"))
    b = edges.select(F.col(target).alias("t"), F.col(source).alias("s2"), F.col(vector).alias("v2"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    cos = dot("v1", "v2") / (F.sqrt(dot("v1", "v1")) * F.sqrt(dot("v2", "v2")))
    angle = F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))
    pairs = a.join(b, "t").where(F.col("s1") < F.col("s2")).select("t", angle.alias("angle"))
    return pairs.groupBy(F.col("t").alias(target)).agg(F.array(*[F.sum(F.exp(-eta * (F.col("angle") - c) * (F.col("angle") - c))) for c in centers]).alias("features"))


def radius_edges(nodes: DataFrame, id_col: str, xyz: Sequence[str], radius: float, cap: int | None = None, group: str | None = None) -> DataFrame:
    """(src, dst, distance) of nodes within radius of each other, in both directions; at most cap nearest for each src.

    Nodes meet only within their grid cell of side radius and the cells around it. With cap, crowded cells are cut finer, so
    that the work grows with the nodes and not with their pairs; ids are unique.
    """
    if cap is not None:
        return _nearest_edges(nodes, id_col, xyz, radius, cap, group)
    keys = [group] if group else []
    cell = [F.floor(F.col(c) / radius).cast("long") for c in xyz]
    own = nodes.select(F.col(id_col).alias("src"), *keys, *[F.col(c).alias(f"a_{c}") for c in xyz], *[x.alias(f"c_{c}") for x, c in zip(cell, xyz, strict=True)])
    near = nodes.select(F.col(id_col).alias("dst"), *keys, *[F.col(c).alias(f"b_{c}") for c in xyz], *[x.alias(f"c_{c}") for x, c in zip(cell, xyz, strict=True)])
    for c in xyz:
        near = near.withColumn(f"c_{c}", F.explode(F.array(*[F.col(f"c_{c}") + k for k in (-1, 0, 1)])))
    d = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in xyz), F.lit(0.0)))
    return own.join(near, [*keys, *[f"c_{c}" for c in xyz]]).where("src <> dst").select(*keys, "src", "dst", d.alias("distance")).where(F.col("distance") <= radius)


def _nearest_edges(nodes: DataFrame, id_col: str, xyz: Sequence[str], radius: float, cap: int, group: str | None) -> DataFrame:
    """radius_edges() with at most cap edges a node, the nearest, smaller ids on ties.

    Nodes at one place share their search, and only the cap + 1 smallest ids of a place can be anyone's neighbours. A place
    begins at the coarsest halving of the grid at which its cell is not crowded, and looks as far as such a cell is wide. If it
    finds cap + 1 nodes (itself among them), no nearer one is elsewhere; else it looks again, twice as far, up to radius.
    """
    keys, n = ([group] if group else []), len(xyz)
    xs, fs, cs = ([f"_{k}{i}" for i in range(n)] for k in "xfc")
    # cells are a little wider than what is looked for in them, so that rounding moves nothing out of reach
    fine = radius * (1 + 2.0**-20) / (1 << DEPTH)
    there = [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in xyz] + [F.col(k).isNotNull() for k in keys]
    rows = nodes
    for ok in there:
        rows = rows.where(ok)
    rows = settle(rows.select(F.col(id_col).alias("src"), *keys, *[F.col(c).cast("double").alias(x) for c, x in zip(xyz, xs, strict=True)]))
    first = F.row_number().over(Window.partitionBy(*keys, *xs).orderBy("src"))
    cells = [F.floor(F.col(x) / fine).cast("long").alias(f) for x, f in zip(xs, fs, strict=True)]
    known = settle(rows.withColumn("_rn", first).where(F.col("_rn") <= cap + 1).select(*keys, F.col("src").alias("dst"), "_rn", *xs, *cells))
    at = lambda level: [F.shiftright(f, DEPTH - level).alias(c) for f, c in zip(fs, cs, strict=True)]
    every = lambda levels: F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), *at(k)) for k in levels])).alias("_e")

    counts = settle(known.groupBy(*keys, *fs).agg(F.count("*").alias("_n")).select(*keys, *fs, "_n", every(range(DEPTH))).select(*keys, *fs, "_n", "_e.*"))
    crowded = counts.groupBy(*keys, "_level", *cs).agg(F.sum("_n").alias("_n")).where(F.col("_n") > CROWD).drop("_n")
    begin = counts.join(crowded, [*keys, "_level", *cs], "left_semi").groupBy(*keys, *fs).agg((F.max("_level") + 1).alias("_level"))
    asked = settle(known.where("_rn = 1").join(begin, [*keys, *fs], "left").select(*keys, F.col("dst").alias("_spot"), *xs, *fs, F.coalesce("_level", F.lit(0)).alias("_level")))

    found = None
    while levels := sorted(r[0] for r in asked.select("_level").distinct().collect()):  # at most DEPTH + 1
        around = asked.withColumns({c: F.get(F.array(*[F.shiftright(f, DEPTH - k) for k in range(DEPTH + 1)]), F.col("_level")) for f, c in zip(fs, cs, strict=True)})
        for c in cs:
            around = around.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
        others = known.select(*keys, "dst", *[F.col(x).alias(f"_to{x}") for x in xs], every(levels)).select(*keys, "dst", *[f"_to{x}" for x in xs], "_e.*")
        d = F.sqrt(sum(((F.col(x) - F.col(f"_to{x}")) * (F.col(x) - F.col(f"_to{x}")) for x in xs), F.lit(0.0)))
        reach = F.get(F.array(*[F.lit(radius / (1 << k)) for k in range(DEPTH + 1)]), F.col("_level"))
        pairs = around.join(others, [*keys, "_level", *cs]).select(*keys, "_spot", *xs, *fs, "_level", "dst", d.alias("distance")).where(F.col("distance") <= reach)
        nearest = F.row_number().over(Window.partitionBy("_spot").orderBy("distance", "dst"))
        lists = pairs.withColumn("_rn", nearest).where(F.col("_rn") <= cap + 1).groupBy("_spot", *keys, *xs, *fs, "_level").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("_near"))
        lists = settle(lists)
        sure = (F.size("_near") > cap) | (F.col("_level") == 0)
        some = lists.where(sure).select(*keys, *xs, "_near")
        found = some if found is None else found.unionByName(some)
        asked = settle(lists.where(~sure).select(*keys, "_spot", *xs, *fs, (F.col("_level") - 1).alias("_level")))
    if found is None:
        return rows.select(*keys, "src", F.col("src").alias("dst"), F.lit(0.0).alias("distance")).where("false")
    own = F.slice(F.filter("_near", lambda e: e["dst"] != F.col("src")), 1, cap)
    return rows.join(found, [*keys, *xs]).select(*keys, "src", F.explode(own).alias("_e")).select(*keys, "src", "_e.dst", "_e.distance")


@dataclass(frozen=True)
class Kernel:
    """A function of a text that needs a library: load() returns the function, once a worker; a bad input gives None."""

    name: str
    library: str
    load: Callable[[], Callable[[str], object]]
    out_type: str = "string"

    def check(self) -> None:
        try:
            importlib.import_module(self.library)
        except ImportError as e:
            raise ImportError(f"{self.name} needs {self.library}, which is not installed") from e


def apply_kernel(df: DataFrame, key: str, out: str, kernel: Kernel, check: bool = True) -> DataFrame:
    """out = kernel(key), once for each distinct non-null key, joined back; null keys and failures give null."""
    require_columns(df, key)
    if check:
        kernel.check()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = kernel.load()

        def one(x):
            try:
                return fn(x)
            except Exception:  # a row's failure is that row's null
                return None

        for b in batches:
            yield b.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    dim = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    dim = dim.select("_key", F.pandas_udf(run, kernel.out_type)(F.col("_key")).alias("_out"))
    return df.drop(out).join(dim, F.col(key) == F.col("_key"), "left").withColumnRenamed("_out", out).drop("_key")


def pipeline_clean(df: DataFrame, key: str, steps: Sequence[Kernel], out: str, check: bool = True) -> DataFrame:
    """The kernels one after the other, each on what the one before left; rows stay, a failed one with null."""
    now = df.withColumn(out, F.col(key))
    for step in steps:
        now = apply_kernel(now, out, "_next", step, check).drop(out).withColumnRenamed("_next", out)
    return now


def flag_set(found: str, name: str) -> object:
    """A column of the sorted distinct entries of an array column, joined by ' | '; empty if there is none."""
    return F.array_join(F.array_sort(F.array_distinct(found)), " | ").alias(name)


def external_process(df: DataFrame, column: str, out: str, command: Sequence[str]) -> DataFrame:
    """Feeds a batch's values, a line each, to a program and reads a line back for each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [("" if x is None else str(x)).replace("\n", " ") for x in b[column]]
            got = subprocess.run(list(command), input="\n".join(lines) + "\n", capture_output=True, text=True, check=True).stdout.split("\n")
            if len(got) < len(lines):
                raise RuntimeError("the program returned fewer lines than it was given")
            yield b.assign(**{out: got[: len(lines)]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, `{out}` string")
