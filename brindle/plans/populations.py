"""Protonation states: microstate tables, one-proton edges, fold statistics, population fits, preferred states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import connected_components
from brindle.sources.tables import settle


def microstates(df: DataFrame, key: str, listed: str) -> DataFrame:
    """(key, state_id, state): the comma-separated states of each row, trimmed, first of equal ones kept, numbered from 0."""
    states = F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda s: F.trim(s)), lambda s: s != ""))
    return df.select(key, F.posexplode(states).alias("state_id", "state"))


def proton_edges(states: DataFrame, key: str = "mol", charge: str = "charge", state: str = "state_id", accept: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) of acid x base pairs of one molecule whose charges differ by one; accept tells real ones apart."""
    acid = states.select(key, F.col(charge).alias("_q"), F.col(state).alias("acid"))
    base = states.select(key, (F.col(charge) + 1).alias("_q"), F.col(state).alias("base"))
    pairs = acid.join(base, [key, "_q"]).drop("_q")
    ok = F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(True)
    judged = pairs.withColumn("reason", F.when(~ok, "not one proton apart"))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def graph_status(molecules: DataFrame, states: DataFrame, edges: DataFrame, key: str = "mol", state: str = "state_id") -> DataFrame:
    """(key, status): NO_MICROSTATES, NO_TRANSITIONS, CONNECTED or DISCONNECTED."""
    nodes = states.select(key, F.xxhash64(key, state).alias("n"))
    links = edges.select(F.xxhash64(key, "acid").alias("a"), F.xxhash64(key, "base").alias("b"))
    parts = connected_components(links.unionByName(nodes.select(F.col("n").alias("a"), F.col("n").alias("b"))), settle)
    per = nodes.join(parts, F.col("n") == F.col("node")).groupBy(key).agg(F.count_distinct("component").alias("parts"))
    n_edges = edges.groupBy(key).agg(F.count("*").alias("edges"))
    out = molecules.select(key).distinct().join(per, key, "left").join(n_edges, key, "left")
    status = F.when(F.col("parts").isNull(), "NO_MICROSTATES").when(F.col("edges").isNull(), "NO_TRANSITIONS").when(F.col("parts") == 1, "CONNECTED").otherwise("DISCONNECTED")
    return out.select(key, status.alias("status"))


def fold_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and population std of the folds' predictions."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n_folds"))


def population_fit(edges: DataFrame, component: str, ph: float = 7.0) -> DataFrame:
    """(component, node, log_weight, probability) from edges (component, acid, base, pka), by least squares.

    Each edge asks log10(base / acid) to be ph - pka; the smallest node is the reference. One component is one group.
    """
    kinds = dict(edges.dtypes)
    rows = edges.select(F.col(component).alias("component"), F.struct("acid", "base", F.col("pka").cast("double").alias("pka")).alias("e"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(1), []
            acids, bases, pkas = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = lists.offsets.to_numpy().tolist()
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                nodes, at = np.unique(np.concatenate([acids[lo:hi], bases[lo:hi]]), return_inverse=True)
                m, each = np.zeros((hi - lo, len(nodes))), np.arange(hi - lo)
                m[each, at[hi - lo :]] += 1
                m[each, at[: hi - lo]] -= 1
                x = np.zeros(len(nodes))
                x[1:] = np.linalg.lstsq(m[:, 1:], ph - pkas[lo:hi], rcond=None)[0]
                share = 10.0 ** (x - x.max())
                out.append((nodes, x, share / share.sum()))
            if out:
                names = b.column(0).take(pa.array(np.repeat(np.arange(len(out)), [len(o[0]) for o in out])))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([o[0] for o in out]), lists.values.field(0).type), *[pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2)]], names=["component", "node", "log_weight", "probability"])

    # one list a component, many of them a batch: a component costs its arithmetic and no frame of its own
    whole = rows.groupBy("component").agg(F.sort_array(F.collect_list("e")).alias("es"))
    return whole.mapInArrow(solve, f"component {kinds[component]}, node {kinds['acid']}, log_weight double, probability double")


def preferred_states(states: DataFrame, key: str, component: str, n_edges: str, n_nodes: str, probability: str, charge: str, state: str) -> DataFrame:
    """Each key's state: in the component with most transitions, then most nodes, then the lowest index; there by probability, charge (both high first), id."""
    w = Window.partitionBy(key).orderBy(F.desc(n_edges), F.desc(n_nodes), F.asc(component), F.desc(probability), F.desc(charge), F.asc(state))
    return states.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
