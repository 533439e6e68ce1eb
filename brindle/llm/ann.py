"""Approximate nearest neighbours by a hash-prefix forest.

Every tree draws random hyperplanes; a vector's signs against them, in order, are its hash string, and a tree is the
sorted array of these strings. A query descends each tree to the longest prefix that any string shares with its own, which
is a range of the array; then all trees ascend together, a bit at a time, widening their ranges until these hold
enough candidates. Prefix lengths so adapt to how dense the data is around the query. Candidates are scored exactly. How many
are enough is what a sample of a cell's queries needs there, by brute force within the cell: few where vectors have clusters,
up to all where they have no structure.

The index is cut into cells of bounded size by the prefixes of one more tree, the longer the denser the data: a vector is in
one cell, and a cell holds a forest. A query is routed to its own prefix and to neighbouring ones, likeliest first: from its
distance to each hyperplane follows how likely a neighbour is on the other side, and it goes to as many cells as hold a
neighbour with the probability REACH. So what is shuffled is the index once, and a query once for each cell it goes to; near
neighbours mean few cells, and only vectors without any structure send a query everywhere. Largest inner products become
nearest directions by one more coordinate that brings all vectors to the same length. Equal vectors are indexed once, with as
many of their smallest ids as a result can hold, so any number of copies costs one entry and loses nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, fresh, read, settle

K = 20
TREES = 32
BITS = 32
#: Trees ascend until their ranges together hold this share of a cell's vectors (a vector counts in each tree that has it): the
#: least of these at which a cell's sample of queries finds FOUND of its neighbours in the cell, so the data decide.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.8, 3.0, float(TREES))
FOUND = 0.97
CELL_SAMPLE = 48
#: A cell's vectors, at most, and the queries that one task of a cell answers, about.
CELL_ROWS = 8_192
BLOCK_ROWS = 4_096
#: A query's cells hold a neighbour with this probability, at the angle of neighbours that a sample shows.
REACH = 0.98
#: Bits of the routing tree; vectors that agree in all of them are dealt into parts of a cell.
ROUTE_BITS = 48
#: Vectors and queries of the sample that tells the angle of neighbours. It decides the number of cells a query goes to.
SAMPLE_VECTORS, SAMPLE_QUERIES = 2_000, 200
QUERY_EVERY = 20
SEED = 11


class Routes:
    """The routing tree: its hyperplanes, and its leaves, which are the cells.

    counts maps a leaf (depth, prefix) to its vectors; leaves tile all strings, in the order of lows, their least strings.
    """

    def __init__(self, width: int, top: float, seed: int = SEED) -> None:
        self.planes, self.top = np.random.default_rng(seed + 1).normal(size=(width + 1, ROUTE_BITS)), top
        self.leaves: list[tuple[int, int]] = [(0, 0)]
        self.parts, self.cosine, self.lift = [1], 1.0, 0.0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The strings of indexed vectors, as whole numbers."""
        rest = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        bits = vectors @ self.planes[:-1] + rest[:, None] * self.planes[-1] > 0
        return (bits.astype(np.int64) << np.arange(ROUTE_BITS - 1, -1, -1, dtype=np.int64)).sum(axis=1)

    def grow(self, counted, n: int) -> None:
        """Cuts until no leaf has more than CELL_ROWS vectors; counted(depth, prefixes, at) gives the vectors of each prefix at a depth, within prefixes at depth at."""
        done: dict[tuple[int, int], int] = {}
        depth, open_ = 0, {0: n}
        while open_:
            done |= {(depth, p): c for p, c in open_.items() if c <= CELL_ROWS or depth == ROUTE_BITS}
            over = [p for p, c in open_.items() if c > CELL_ROWS and depth < ROUTE_BITS]
            if not over:
                break
            step = min(ROUTE_BITS - depth, max(1, (max(open_[p] for p in over) // CELL_ROWS).bit_length()))
            found = counted(depth + step, over, depth)
            for p in over:  # back to the shortest prefixes that are small enough
                level = {(p << step) + i: found.get((p << step) + i, 0) for i in range(1 << step)}
                self._cut(level, depth + step, depth, p, done)
            open_ = {p: c for (d, p), c in done.items() if d == depth + step and c > CELL_ROWS and d < ROUTE_BITS}
            done = {k: c for k, c in done.items() if not (k[0] == depth + step and k[1] in open_)}
            depth += step
        self.leaves = sorted(done, key=lambda leaf: leaf[1] << (ROUTE_BITS - leaf[0]))
        self.parts = [max(1, -(-done[leaf] // CELL_ROWS)) if done[leaf] else 0 for leaf in self.leaves]

    def _cut(self, level: dict[int, int], depth: int, at: int, prefix: int, done: dict[tuple[int, int], int]) -> None:
        total = sum(level[q] for q in range(prefix << (depth - at), (prefix + 1) << (depth - at)))
        if total <= CELL_ROWS or at == depth:
            done[at, prefix] = total
        else:
            self._cut(level, depth, at + 1, 2 * prefix, done)
            self._cut(level, depth, at + 1, 2 * prefix + 1, done)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        lows = np.array([p << (ROUTE_BITS - d) for d, p in self.leaves], dtype=np.int64)
        return np.searchsorted(lows, codes, "right") - 1

    def route(self, query: np.ndarray, reach: float) -> list[int]:
        """The query's own cell, and those, likeliest first, that together hold a neighbour with the probability reach."""
        number = {leaf: i for i, leaf in enumerate(self.leaves)}
        # a neighbour is its share along the query, its share along the coordinate that lifts it, and a rest in any direction
        centre = self.cosine * (query / np.linalg.norm(query) @ self.planes[:-1]) + self.lift * self.planes[-1]
        rest = math.sqrt(max(1e-6, 1 - self.cosine**2 - self.lift**2))
        ones = [0.5 * math.erfc(-m / rest / math.sqrt(2)) for m in centre.tolist()]
        own = int(self.cells(self.codes(query[None, :]))[0])
        out, mass, todo = [own] if self.parts[own] else [], 0.0, [(-1.0, 0, 0)]
        while todo and mass < reach:
            p, depth, prefix = heapq.heappop(todo)
            at = number.get((depth, prefix))
            if at is not None:
                mass -= p
                if self.parts[at] and at != own:
                    out.append(at)
                continue
            heapq.heappush(todo, (p * ones[depth], depth + 1, 2 * prefix + 1))
            heapq.heappush(todo, (p * (1 - ones[depth]), depth + 1, 2 * prefix))
        return out


class Forest:
    """The trees over one cell's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.vectors, self.bits, n = vectors, bits, vectors.shape[1]
        norms = np.einsum("ij,ij->i", vectors, vectors)
        top = norms.max()
        lifted = np.c_[vectors, np.sqrt(np.maximum(top - norms, 0.0))]
        self.planes = np.random.default_rng(seed).normal(size=(trees, n + 1, bits))
        self.powers = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        self.trees = []
        for p in self.planes:
            h = self.strings(lifted, p)
            order = np.argsort(h, kind="stable")
            self.trees.append((h[order], order))

    def strings(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((vectors @ planes > 0).astype(np.uint64) * self.powers).sum(axis=1, dtype=np.uint64)

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the range of the tree's array at the prefix length where the trees hold enough together."""
        lifted = np.c_[queries, np.zeros(len(queries))]
        own = [self.strings(lifted, p) for p in self.planes]
        lo = np.zeros((len(self.trees), len(queries)), dtype=np.int64)
        hi = np.zeros_like(lo)
        open_ = np.arange(len(queries))
        for length in range(self.bits, -1, -1):
            below = np.uint64((1 << (self.bits - length)) - 1)
            for t, (h, _) in enumerate(self.trees):
                first = own[t][open_] & ~below
                lo[t, open_] = np.searchsorted(h, first, "left")
                hi[t, open_] = np.searchsorted(h, first | below, "right")
            open_ = open_[(hi[:, open_] - lo[:, open_]).sum(axis=0) < enough]
            if not len(open_):
                break
        return lo, hi

    def share(self, queries: np.ndarray, k: int, found: float = FOUND) -> float:
        """The least of SHARES at which these queries find that part of their true k best rows."""
        k = min(k, len(self.vectors))
        true = [np.partition(self.vectors @ q, -k)[-k] - 1e-12 for q in queries]
        for ascent in SHARES:
            got = [min(k, int((self.vectors[rows] @ q >= least).sum())) for q, rows, least in zip(queries, self.nearest(queries, k, ascent), true, strict=True)]
            if sum(got) >= found * k * len(queries):
                break
        return ascent

    def nearest(self, queries: np.ndarray, k: int, ascent: float) -> Iterator[np.ndarray]:
        """For each query, the rows of its k best candidates, at least (more on ties)."""
        n = len(self.vectors)
        lo, hi = self.ranges(queries, min(n * len(self.trees), max(4 * k, int(ascent * n))))
        for i, q in enumerate(queries):
            mark = np.zeros(n, dtype=bool)
            for t, (_, order) in enumerate(self.trees):
                mark[order[lo[t, i] : hi[t, i]]] = True
            rows = np.flatnonzero(mark)
            scores = self.vectors[rows] @ q
            if len(rows) > k:
                rows = rows[scores >= np.partition(scores, -k)[-k] - 1e-12]
            yield rows


def _usable(v: Column) -> Column:
    """Not null, with finite components, one of which is not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Vectors travel as bytes: Spark's Arrow writer measures a list column anew for every row."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), dtype="<f8") for x in column])


def _coded(routes: Routes):
    """(least, v, ids, code) of indexed vectors, v and ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                ids = [np.array(x, dtype="<i8").tobytes() for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _bytes(v), pa.array(ids, pa.binary()), pa.array(routes.codes(v))], names=["least", "v", "ids", "code"])

    return run


def _placed(routes: Routes):
    """(least, v, ids, cell, part): where each indexed vector is."""
    parts = np.maximum(np.array(routes.parts), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = routes.cells(b.column(3).to_numpy())
            part = (b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["least", "v", "ids", "cell", "part"])

    return run


def _routed(routes: Routes, reach: float):
    """(least, v, cell, part): where each asked vector goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            to = [(i, c, p) for i, q in enumerate(v) for c in routes.route(q, reach) for p in range(routes.parts[c])]
            for at in range(0, len(to), 50_000):
                rows, cells, parts = (np.array(x) for x in zip(*to[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _bytes(v).take(pa.array(rows)), pa.array(cells.astype(np.int32)), pa.array(parts.astype(np.int32))], names=["least", "v", "cell", "part"])

    return run


def _search(k: int, ascent: float | None):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "score": [], "ids": []}
        if index.num_rows and queries.num_rows:
            index = index.sort_by("least")
            vectors, asked = _vectors(index.column("v")), _vectors(queries.column("v"))
            ids = [np.frombuffer(x.as_py(), dtype="<i8").tolist() for x in index.column("ids")]
            forest = Forest(vectors)
            sample = asked[np.argsort(queries.column("least").to_numpy())[np.unique(np.linspace(0, len(asked) - 1, CELL_SAMPLE).astype(int))]]
            share = forest.share(sample, k + 1) if ascent is None else ascent
            for name, q, rows in zip(queries.column("least").to_pylist(), asked, forest.nearest(asked, k + 1, share), strict=True):
                scores = (vectors[rows] * q).sum(axis=1)
                order = np.lexsort((rows, -scores))[: k + 1]
                for i in order.tolist():
                    out["query"].append(name)
                    out["score"].append(float(scores[i]))
                    out["ids"].append(ids[rows[i]])
        return pa.table({"query": pa.array(out["query"], pa.int64()), "score": pa.array(out["score"], pa.float64()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    return run


def _neighbour(index: DataFrame, asked: DataFrame, n: int, k: int, top: float) -> tuple[float, float]:
    """(cosine, lift): the shares of a k-th neighbour along its query and along the lifting coordinate, from a bounded sample; a smaller cosine than most have."""
    some = lambda df, m: df.select("least", "v").orderBy(F.xxhash64(F.lit(5), "least"), "least").limit(m).collect()
    vectors, queries = some(index, SAMPLE_VECTORS), some(asked, SAMPLE_QUERIES)
    x, names = np.array([r["v"] for r in vectors]), np.array([r["least"] for r in vectors])
    place, cosines, lifts = max(1, round(k * len(x) / n)), [], []
    for r in queries:
        q = np.array(r["v"])
        others = np.flatnonzero(names != r["least"])
        near = others[np.argsort(-(x[others] @ q), kind="stable")]
        if len(near) >= place:
            cosines.append(x[near[place - 1]] @ q / (np.linalg.norm(q) * math.sqrt(top)))
            lifts += [math.sqrt(max(0.0, 1 - x[i] @ x[i] / top)) for i in near[:place]]
    return (min(0.999, max(0.02, float(np.quantile(cosines, 0.25)))), min(0.95, float(np.median(lifts)))) if cosines else (0.02, 0.0)


def _hits(rows: DataFrame, k: int, ascent: float | None, reach: float) -> DataFrame:
    """(id, hits) for every row that asks; rows (id, v, asks) have vectors of one length."""
    # a vector's smallest k + 1 ids: rows of one vector beyond these cannot be in any result. Tasks cut to k + 1 before the shuffle
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    index = settle(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("least"), "v", "ids"))
    asked = settle(rows.where("asks").groupBy("v").agg(F.min("id").alias("least")).select("least", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    n, top, width = index.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    routes = Routes(width or 1, top or 1.0)
    coded = settle(index.mapInArrow(_coded(routes), "least long, v binary, ids binary, code long"))

    def counted(depth: int, prefixes: list[int], at: int) -> dict[int, int]:
        """One row for each part of a cell's size, about."""
        within = coded.select(F.shiftright("code", ROUTE_BITS - depth).alias("p"), F.shiftright("code", ROUTE_BITS - at).alias("q")) if at else coded.select(F.shiftright("code", ROUTE_BITS - depth).alias("p"), F.lit(0).cast("long").alias("q"))
        big = coded.sparkSession.createDataFrame([(p,) for p in prefixes], "q long")
        return {r["p"]: r["count"] for r in within.join(F.broadcast(big), "q", "left_semi").groupBy("p").count().collect()}

    if n > CELL_ROWS:
        routes.grow(counted, n)
        routes.cosine, routes.lift = _neighbour(index, asked, n, k, top)
    routed = settle(asked.mapInArrow(_routed(routes, reach), "least long, v binary, cell int, part int"))
    blocks = routed.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    left = coded.mapInArrow(_placed(routes), "least long, v binary, ids binary, cell int, part int").join(blocks, ["cell", "part"])
    left = left.select("least", "v", "ids", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = routed.join(blocks, ["cell", "part"]).select("least", "v", "cell", "part", F.pmod(F.xxhash64("least"), "blocks").cast("int").alias("block"))
    by = ["cell", "part", "block"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k, ascent), "query long, score double, ids array<long>")
    # the k + 1 best ids of each asked vector, then of each query without itself
    best = near.select("query", "score", F.explode("ids").alias("id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).select("query", F.struct("n", "score", "id").alias("hit"))
    hits = best.groupBy("query").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    named = rows.where("asks").select("id", "v").join(asked, "v").select("id", "least")
    return named.join(hits, F.col("least") == F.col("query")).select("id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))


def search(table: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", ascent: float | None = None, reach: float = REACH) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows, by inner product, of every row for which queries is true.

    A row is never its own neighbour; ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows with a null id. Only vectors of the same length are neighbours. Rows that repeat an id
    are candidates of their own, but a query is not its own neighbour under any of them. An empty table gives an empty table.
    An id column that has the name of a result gets underscores. ascent fixes the share of a cell's vectors that trees ascend to.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = settle(rows.where(F.col("id").isNotNull() & _usable(F.col("v"))))
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = table.sparkSession.createDataFrame([], "id long, hits array<struct<n:int,score:double,id:bigint>>")
    for i, width in enumerate(widths):  # one, as a rule
        got = _hits(rows.where(F.size("v") == width) if len(widths) > 1 else rows, k, ascent, reach)
        found = got if i == 0 else found.unionByName(got)
    flat = found.select(F.col("id").alias("query_id"), F.posexplode("hits").alias("p", "hit"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.id").alias(fresh(["query_id", "rank", "score"], id_col)), F.col("hit.score").alias("score"))


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
