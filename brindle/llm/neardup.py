"""Near-duplicates by word shingles: MinHash bands propose pairs, the shingles themselves decide.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of SIMILARITY or more. A band is
a hash of ROWS minima; texts that share one meet in its bucket, which a pair of similarity s does in at least one of BANDS
with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8. A bucket loses none of its pairs, however many texts it holds. In a
first pass every text is verified against one head of each of its buckets. In the rounds after it, texts of a bucket that are
not yet connected are compared: those outside the bucket's largest component with the texts of other components, first with
about 16 that a hash deals to them, then, where components are left, with about 256, and in the end with all of
them, block by block. So a group of many copies is joined for a few pairs a text, and only texts that stay unlike meet all others. Before shingles are
looked at, each pair is told apart within the join: a text carries a bitmap of its shingles, and two sets differ in at least
as many shingles as their bitmaps differ in bits, so a pair whose bitmaps differ in more than its sizes allow cannot be
similar. Equal texts are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.llm.common import blocks, discard, fresh, settle, settle_small
from brindle.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SEED = 42
#: Longs of a text's bitmap; the more, the fewer pairs of long texts are looked at in vain.
MAP_LONGS = 16
#: Texts of a bucket are compared in blocks of about so many; it bounds a task and never what is compared.
BLOCK_TEXTS = 4096
#: Texts are shingled in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: Texts of a bucket that one meets in each round, about, until what is left meets all.
ROUNDS = (16, 256)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z lower-cased. Fewer words than a shingle has, or none, are one shingle."""
    w = (text or b"").lower().split()
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)]
    return np.unique(np.fromiter((h(g, SEED) for g in grams), dtype="<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """The BANDS keys of a text, as signed longs."""
    least = np.full(len(_ODD), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (_ODD[:, None] * hashes[None, at : at + 2048]).min(axis=1), out=least)
    raw = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(raw[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """MAP_LONGS longs with a bit set for each shingle, by the hash's upper bits."""
    bits = np.zeros(64 * MAP_LONGS, dtype=np.uint8)
    bits[(hashes >> np.uint64(40)) % np.uint64(64 * MAP_LONGS)] = 1
    return np.packbits(bits).view("<i8")


def may_be_similar(a: list[Column], b: list[Column], n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m shingles with these bitmaps can be similar enough: at most (1 - least) / (1 + least) of both may differ."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - F.lit(1e-9)) & (differ <= (n + m) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9))


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, n, keys, map) of texts (node, t): the number of shingles, the band keys and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in blocks(b, 1, SLICE_BYTES)):
            sizes, keys, maps = [], [], []
            for t in part.column(1):
                found = shingles(t.as_py())
                sizes.append(len(found))
                keys.append(bands(found))
                maps.append(bitmap(found))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], names=["node", "n", "keys", "map"])

    return texts.mapInArrow(run, "node long, n long, keys array<long>, map array<long>")


def _shingled(texts: DataFrame) -> DataFrame:
    """(node, s) of texts (node, t): the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1, SLICE_BYTES):
                found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "s"])

    return texts.mapInArrow(run, "node long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough; sets stay in the JVM, a pair of them at a time."""
    one, two = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return met.where(F.col("both") >= F.lit(least) * (F.col("all") - F.col("both")) - F.lit(1e-9)).select("a", "b")


def _met(left: DataFrame, right: DataFrame, on: list[str], where: Column, least: float) -> DataFrame:
    """The pairs (a, b), a < b, of rows of left and right (node, n, map) that meet on columns and hold where and their bitmaps allow."""
    ones, twos = [f"p{i}" for i in range(MAP_LONGS)], [f"q{i}" for i in range(MAP_LONGS)]
    flat = lambda df, names, tag: df.select(*on, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in (*on, "map")], *[F.get("map", F.lit(i)).alias(c) for i, c in enumerate(names)])
    can = may_be_similar([F.col(c) for c in ones], [F.col(c) for c in twos], F.col("n_l"), F.col("n_r"), least)
    met = flat(left, ones, "l").join(flat(right, twos, "r"), on).where(can & where)
    return met.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()


def _torn(members: DataFrame) -> DataFrame:
    """(key, main, all, rest) of the keys whose members (key, node, part, ...) are of several parts: the largest part, and the
    number of all members and of those outside it."""
    parts = members.groupBy("key", "part").agg(F.count("*").alias("c"))
    keys = parts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("k")).where("k > 1")
    return keys.select("key", F.col("m.part").alias("main"), "all", (F.col("all") - F.col("m.c")).alias("rest"))


def _compared(dealt: DataFrame, left: list[Column], right: list[Column], on: list[str], least: float) -> DataFrame:
    """The pairs of members that meet in a cell, are of different parts, one of them outside the largest, and may be similar."""
    slim = ("key", "node", "part", "n", "map")
    side = lambda where, cell: dealt.where(where).select(*slim, (F.col("part") != F.col("main")).alias("rest"), *cell)
    once = (F.col("part_l") != F.col("part_r")) & (~F.col("rest_r") | (F.col("node_l") < F.col("node_r")))
    return _met(side(F.col("part") != F.col("main"), left), side(F.lit(True), right), on, once, least)


def _unconnected(members: DataFrame, keys: DataFrame, least: float, size: int | None, block: int) -> DataFrame:
    """The pairs of members (key, node, part, n, map) of torn keys that are of different parts and may be similar.

    With a size, members meet those of the same cell of about so many; without, both sides are dealt into blocks
    by a hash and each block of the one meets each of the other, so that no task holds more than two blocks of a key.
    """
    dealt = members.join(keys, "key")
    at = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), n)
    if size:
        # a power of two, so that texts that share many buckets meet the same ones in most of them
        cells = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("all") / F.lit(size))))).cast("long")
        cell = [F.pmod(F.xxhash64(F.lit(size), "node"), cells).alias("i")]
        return _compared(dealt, cell, cell, ["key", "i"], least)
    rows, cols = (F.ceil(F.col(c) / F.lit(block)) for c in ("rest", "all"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return _compared(dealt, [at(rows).alias("i"), every(cols).alias("j")], [at(cols).alias("j"), every(rows).alias("i")], ["key", "i", "j"], least)


def links(docs: DataFrame, text_col: str = "text", least: float = SIMILARITY, block: int = BLOCK_TEXTS, rounds: tuple[int, ...] = ROUNDS, radius: int | None = None) -> DataFrame:
    """Edges (a, b) between hashes of texts; their components are those of the near-duplicates.

    With a radius, texts whose SimHash fingerprints differ in so many bits or fewer are linked first, as op8 links them.
    """
    texts = docs.select(_node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    nodes = settle(_sketches(texts).groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("map").alias("map")))
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64(F.lit(5), "node"), "node")).alias("h")).where("size > 1").select("key", F.col("h.node").alias("head"))
    buckets = settle(keyed.join(heads, "key").select("key", "node", "head"))
    maps = nodes.select("node", "n", "map")
    wanted = texts.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))
    sets = settle(_shingled(wanted))
    # a text meets its head as often as they share buckets, and is compared once
    led = buckets.where(F.col("node") != F.col("head")).select(F.col("node").alias("x"), "head").distinct()
    led = led.join(maps.withColumnRenamed("node", "x"), "x").withColumnRenamed("x", "node")
    seen = settle(_met(led, maps.withColumn("head", F.col("node")), ["head"], F.lit(True), least))
    found, members = settle(_verified(seen, sets, least)), buckets.select("key", "node")
    if radius is not None:
        found = found.unionByName(simhash.text_links(texts, "node", "t", radius))
    for size in (*rounds, None):
        parts = connected_components(found, settle_small)
        placed = members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
        keys = settle_small(_torn(placed))
        if keys.isEmpty():
            break
        now = settle(placed.join(keys.select("key"), "key", "left_semi").join(maps, "node"))
        more = settle(_unconnected(now, keys, least, size, block).join(seen, ["a", "b"], "left_anti"))
        found, seen = found.unionByName(settle(_verified(more, sets, least))), seen.unionByName(more)
        # where a cell holds all of a bucket, all its pairs have met
        members = now.join(keys.where(F.col("all") > (size or 0)).select("key"), "key", "left_semi").select("key", "node")
    discard(buckets)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """One row of docs for each component of near-duplicates: the one with the smallest id, nulls last, then by a hash of its text.

    Null and empty texts are near-duplicates of each other. Rows are told apart by id and text, so rows that share an id by
    mistake stand for their own components, and copies without an id are reduced like any others. Texts of any length are
    compared whole. An empty table gives an empty table, and docs may have any other columns.
    """
    key, root = fresh(docs.columns, "_key"), fresh(docs.columns, "_root")
    named = F.xxhash64(F.lit(SEED), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    found = connected_components(links(docs, text_col, least, radius=radius), settle_small)
    slim = docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), named.alias("key"))
    slim = slim.join(found, "node", "left").withColumn(root, F.coalesce("component", "node"))
    heads = slim.groupBy(root).agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("h")).select(F.col("h.key").alias(key))
    kept = docs.withColumn(key, named).join(settle(heads), key, "left_semi")
    once = kept.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(root))
    return once.select(*[F.col(f"{root}.`{c}`").alias(c) for c in docs.columns])
