"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a point that is within r/2 bits of both. Every distinct fingerprint
therefore emits all variants of itself within r/2 bits; variants are the shuffle key, and fingerprints that meet on one
are verified. Equal fingerprints are collapsed first, so copies, however many, cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, fresh, read, settle, settle_small
from brindle.operators.graph import connected_components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased: a bit is 1 if it is set in over half the shingles' hashes.

    Fewer words than a shingle has: all of them are the one shingle. No words: 0.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)]
    hashes = np.fromiter((h(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): a row's id and its fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fp at most radius bits apart; distinct has each fp once.

    radius is even: then all fingerprints that meet on a variant are within radius of each other, and a star around the
    least of them joins the same fingerprints as all their pairs do. A bucket holds only points of one ball, so its
    size is bounded by the ball's (65 for radius 2), whatever the data.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even, so that variants meet in the middle")
    masks = [sum(1 << x for x in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    balls = distinct.select("fp", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = balls.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id) for every row; component_id is the smallest id that links reach, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id keep it and count for links; a
    component of such rows alone has a null component_id. Repeated rows stay repeated. An empty table gives an empty table.
    Texts of any length are taken whole, other columns are not read, and an id column that has the name of a result gets
    underscores.
    """
    fps = settle(fingerprints(docs, id_col, text_col))
    nodes = settle(fps.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(links(nodes.select("fp"), radius), settle_small)
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = settle(rooted)
    discard(nodes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(fresh(["fp", "component_id"], id_col)), "fp", "component_id")


def text_links(texts: DataFrame, node: str = "node", text_col: str = "t", radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) from the least node of each component of near_duplicates() to its others; texts that share a node are equal."""
    fps = settle(fingerprints(texts, node, text_col).groupBy("id").agg(F.first("fp").alias("fp")))
    found = connected_components(links(fps.select("fp").distinct(), radius), settle_small)
    rooted = settle_small(fps.join(found, fps["fp"] == found["node"], "left").select("id", F.coalesce("component", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").select("root", "a")
    return settle_small(rooted.join(heads, "root").where("id <> a").select("a", F.col("id").alias("b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stand for their component: the one with the smallest id. Rows with a null id all stay.

    Of rows that repeat that id, each stays only once: they are whole copies or share an id by mistake, and the one with
    the least text is taken.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    kept = found.where(F.col(found.columns[0]) == F.col("component_id")).select(F.col("component_id").alias(id_col)).distinct()
    heads = docs.join(kept, id_col, "left_semi")
    others = [c for c in docs.columns if c != id_col]
    once = heads.groupBy(id_col).agg(F.min(F.struct(text_col, *[F.col(c) for c in others if c != text_col])).alias("_row"))
    once = once.select(*[F.col(c) if c == id_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
