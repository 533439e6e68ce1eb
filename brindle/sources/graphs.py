"""Graph samples: rules for their structure, and batches as disjoint unions.

A graph is a row with x (an array of feature arrays, one a node), src and dst (arrays of node numbers, one an edge) and, where
edges have features, edge_attr (an array of feature arrays, one an edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.checks import require_columns
from brindle.operators.relational import row_index


def graph_rules(x: str = "x", src: str = "src", dst: str = "dst", edge_attr: str | None = None) -> dict[str, Column]:
    """reason -> a column true where a row is a graph in that respect: rules for write_store()."""
    n = F.size(x)
    inside = lambda c: F.forall(c, lambda i: i.isNotNull() & (i >= 0) & (i < n))
    width = F.size(F.get(x, F.lit(0)))
    rules = {
        "no node features": F.col(x).isNotNull() & (n > 0),
        "node features of unlike lengths": F.forall(x, lambda v: v.isNotNull() & (F.size(v) == width)),
        "node features missing or not finite": F.forall(x, lambda v: F.forall(v, lambda z: z.isNotNull() & ~F.isnan(z.cast("double")) & (F.abs(z.cast("double")) < float("inf")))),
        "no edge index": F.col(src).isNotNull() & F.col(dst).isNotNull(),
        "edge index of unlike lengths": F.size(src) == F.size(dst),
        "edge to a node that is not there": inside(src) & inside(dst),
    }
    if edge_attr:
        rules["edge features are not one an edge"] = F.col(edge_attr).isNotNull() & (F.size(edge_attr) == F.size(src))
    return rules


def undirected(df: DataFrame, src: str = "src", dst: str = "dst", edge_attr: str | None = None) -> DataFrame:
    """df with every edge also the other way round, behind its own; edge features are repeated with it."""
    out = df.withColumns({src: F.concat(src, dst), dst: F.concat(dst, src)})
    return out.withColumn(edge_attr, F.concat(edge_attr, edge_attr)) if edge_attr else out


def graph_batches(df: DataFrame, id_col: str, size: int, x: str = "x", src: str = "src", dst: str = "dst", edge_attr: str | None = None, *others: str) -> DataFrame:
    """(batch, ids, x, src, dst, edge_attr, graph, ptr, others): every size rows, in the order of unique ids, as one graph.

    Node numbers are moved by the nodes of the graphs before in the batch, so that the parts stay apart; graph has each node's place in the
    batch, ptr the first node of each graph and the number of all. others become arrays, one element a graph. A batch is one task's work at a time,
    and only it: numbers come from range partitions. Rows must be graphs (graph_rules()); a null array is an error.
    """
    require_columns(df, id_col, x, src, dst, *([edge_attr] if edge_attr else []), *others)
    if size < 1:
        raise ValueError("a batch has one graph at least")
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")))
    parts = {"x": x, "src": src, "dst": dst} | ({"edge_attr": edge_attr} if edge_attr else {})
    rows = df.select(F.col(id_col).alias("_id"), *[sure(c).alias(f"_{k}") for k, c in parts.items()], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(others)])
    rows = row_index(rows, "_id", name="_place").withColumn("_batch", F.floor(F.col("_place") / size)).withColumn("_n", F.size("_x"))
    before = Window.partitionBy("_batch").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int"))
    moved = rows.withColumns({c: F.transform(c, lambda i: i + F.col("_off")) for c in ("_src", "_dst")})
    items = moved.groupBy("_batch").agg(F.sort_array(F.collect_list(F.struct("_place", *[c for c in moved.columns if c not in ("_place", "_batch")]))).alias("_g"))
    each = lambda name: F.transform("_g", lambda g: g[name])
    joined = [F.flatten(each(f"_{k}")).alias(c) for k, c in parts.items()]
    graph = F.flatten(F.transform("_g", lambda g, i: F.array_repeat(i, g["_n"]))).alias("graph")
    ptr = F.concat(each("_off"), F.array(F.element_at(each("_off"), -1) + F.element_at(each("_n"), -1))).alias("ptr")
    return items.select(F.col("_batch").cast("long").alias("batch"), each("_id").alias("ids"), *joined, graph, ptr, *[each(f"_o{i}").alias(c) for i, c in enumerate(others)])
