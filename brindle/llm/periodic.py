"""Periodic runs of words: the Stoye-Gusfield search for branching tandem repeats on a suffix tree, merged to maximal runs.

A run of exponent 4 holds each of its word triples at least three times, so the tree is built over the stretches of words whose
triples do; what lies outside can be in no run. The stretches of a block of documents are one sequence, with separators that
occur once: suffixes are sorted by doubled prefixes, their common prefixes give the nodes of the tree, and every node lists the
leaves of all children but its largest (the smaller-half rule, n log n leaves in all). Leaf i of a node of depth p is the start
of a branching tandem repeat of period p if leaf i + p is also below the node and the words at i and i + 2p differ in what
follows; i - p is tried alike. Such a repeat cannot be rotated right. Rotated left as far as words allow it is a maximal
run, and of the repeats that rotate to the same run the one with the least period names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import blocks, fresh, read, words

# The least exponent and the least length of a run.
EXPONENT = 4
LEAST_WORDS = 6
#: Documents share a suffix tree in blocks of about so many bytes; a longer one has its own.
BLOCK_BYTES = 1 << 21
#: Leaves of a node list that are looked at in one step.
LEAF_STEP = 1 << 20


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """The longest (begin, end) of words in which every triple occurs three times or more, of LEAST_WORDS or more words."""
    if len(codes) < LEAST_WORDS:
        return []
    # pairs and triples are numbered densely in turn, so that keys stay below 2^63
    pair = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)[1]
    _, triple, n = np.unique(pair[:-1] * (codes.max() + 1) + codes[2:], return_inverse=True, return_counts=True)
    often = np.r_[False, n[triple] >= EXPONENT - 1, False]
    edges = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    return [(int(a), int(b) + 2) for a, b in edges if b + 2 - a >= LEAST_WORDS]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted suffixes of codes, and the ranks of all prefixes of 1, 2, 4, ... words, the last of which are all different."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int32)
    levels, n, step = [rank], len(codes), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:].astype(np.int64) + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        new = np.cumsum(np.r_[0, sorted_keys[1:] != sorted_keys[:-1]])
        rank = np.empty(n, dtype=np.int32)
        rank[order] = new
        levels.append(rank)
        step *= 2
        if not n or new[-1] == n - 1:
            return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The words that each sorted suffix shares with the one before it; 0 for the first."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        out[1:] += step
    return out


def nodes(lcp: np.ndarray) -> np.ndarray:
    """Rows (depth, first, last, big_first, big_last) of the tree's inner nodes but the root: their leaves by rank, and those of the largest child."""
    out, stack = [], [[0, 0, -1, -1]]  # depth, first, and the largest child that is closed
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first, last, child = i - 1, i - 1, None
        while stack[-1][0] > depth:
            d, first, a, b = stack.pop()
            if child and child[1] - child[0] > b - a:
                a, b = child
            out.append((d, first, last, a, b))
            child = (first, last)
        if stack[-1][0] < depth:
            stack.append([depth, first, *(child or (first, first))])
        elif child:
            if child[1] - child[0] > stack[-1][3] - stack[-1][2]:
                stack[-1][2:] = child
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def branching_repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats of codes, each once."""
    order, levels = suffix_array(codes)
    tree, place, n = nodes(common_prefixes(order, levels)), levels[-1], len(codes)
    del levels
    padded = np.r_[codes, np.full(2, -1)]
    depth, first, last, big_first, big_last = tree.T
    none = big_first < 0
    left = np.where(none, last + 1 - first, big_first - first)  # leaves before the largest child; those after it follow
    sizes = np.where(none, left, left + last - big_last)
    ends, found, at = np.cumsum(sizes), [], 0
    while at < len(tree):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAF_STEP, "right")))
        node = np.repeat(np.arange(at, stop), sizes[at:stop])
        nth = np.arange(len(node)) - np.repeat(ends[at:stop] - sizes[at:stop] - (ends[at - 1] if at else 0), sizes[at:stop])
        leaf = order[np.where(nth < left[node], first[node] + nth, big_last[node] + 1 + nth - left[node])]
        p, lo, hi = depth[node], first[node], last[node]
        for i in (leaf, leaf - p):
            ok = (i >= 0) & (i + p < n)
            i, q, l, h, forward = i[ok], p[ok], lo[ok], hi[ok], leaf[ok]
            other = np.where(forward == i, i + q, i)
            below = (place[other] >= l) & (place[other] <= h)
            i, q = i[below], q[below]
            branch = padded[np.minimum(i + q, n)] != padded[np.minimum(i + 2 * q, n + 1)]
            found.append(np.stack([i[branch], q[branch]]))
        at = stop
    both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return both[0], both[1]


def _rotated(codes: np.ndarray, start: int, period: int) -> int:
    """How far a tandem repeat can be rotated left: the words before start that equal those one period on."""
    at, step = start, 64
    while at > 0:
        low = max(0, at - step)
        differ = np.flatnonzero(codes[low:at] != codes[low + period : at + period])
        if len(differ):
            return start - (low + int(differ[-1]) + 1)
        at, step = low, step * 2
    return start


def maximal_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of codes, sorted by start, then period."""
    start, period = branching_repeats(codes)
    # of four periods, the two before the branching repeat are already there
    back = start - (EXPONENT - 2) * period
    ok = back >= 0
    ok[ok] = codes[back[ok]] == codes[back[ok] + period[ok]]
    start, period = start[ok], period[ok]
    ends = start + 2 * period
    known: dict[int, list[tuple[int, int]]] = {}
    out = []
    for k in np.lexsort((period, ends)).tolist():
        end, p, i = int(ends[k]), int(period[k]), int(start[k])
        # a multiple of a run's period that fits into it twice rotates to that run
        if any(p % q == 0 and 2 * p <= end - s for s, q in known.get(end, ())):
            continue
        begin = i - _rotated(codes, i, p)
        known.setdefault(end, []).append((begin, p))
        if end - begin >= max(LEAST_WORDS, EXPONENT * p):
            out.append((begin, end - begin, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def block_runs(texts: list[bytes | None]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, and its runs as (start, length, period)."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    if not sizes.sum():
        return split, runs
    names = pa.chunked_array([pa.array(w, pa.binary()) for w in split if w]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(split)), sizes)
    # a word of one document is not that of another, so nothing repeats across documents
    codes = np.unique(owner * (names.max() + 1) + names, return_inverse=True)[1]
    parts = stretches(codes)
    if not parts:
        return split, runs
    top = int(codes.max()) + 1
    one = np.concatenate([np.r_[codes[a:b], top + k] for k, (a, b) in enumerate(parts)])
    lengths = np.array([b - a + 1 for a, b in parts])
    begins, begun = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    for s, n, p in maximal_runs(one):
        k = int(np.searchsorted(begins, s, "right")) - 1
        word = parts[k][0] + s - int(begins[k])
        doc = int(owner[word])
        runs[doc].append((word - int(begun[doc]), n, p))
    return split, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapsed(split: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(split)
    kept = np.ones(len(split), dtype=bool)
    for s, n, p in runs:
        kept[s + p : s + n] = False
    return b" ".join(split[i] for i in np.flatnonzero(kept).tolist())


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULTS = ("n_words", "runs", "collapsed")


def periodic_runs(docs: DataFrame, keep: list[str], text: Column | str = "text") -> DataFrame:
    """keep, and n_words, runs and collapsed for every row of docs.

    runs holds (start, length, period) of every maximal run of words with a length of at least max(6, 4 * period), by start, then
    period; words are numbered from 0. collapsed is the text's words, joined by one space, without those that a run holds after
    its first period. Null and empty texts have no words and no runs. Texts of any length are taken whole. Repeated rows are
    judged one by one, rows may have null ids, an empty table gives an empty table, and columns of keep that have the name of
    a result are replaced by it.
    """
    keep = [c for c in keep if c.lower() not in RESULTS]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, len(keep), BLOCK_BYTES):
                split, found = block_runs(part.column(len(keep)).to_pylist())
                spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], kind)
                left = pa.array([collapsed(w, r) for w, r in zip(split, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(w) for w in split], pa.int64()), spans, left], names=[*keep, *RESULTS])

    body = F.col(f"`{text}`") if isinstance(text, str) else text
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], body.cast("binary").alias(fresh(keep, "t"))).mapInArrow(run, schema)


def with_periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text whose words, for a tenth of the ids, repeat with a period that the id's CRC-32 gives from a word that it gives on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, w = F.floor(h / F.lit(10)), words(text)
    n = F.size(w)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    # n - a is less than 3 + g % 8 periods
    tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), 10))
    planted = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), ["doc_id"], with_periodic_tail(F.col("doc_id"), F.col("text")))
    # runs are sorted, so of equal exponents the first stays
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Runs from equal 5-word windows: those that are q apart, over consecutive places, are a run of period q, and a run of exponent 4 has one at least.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, CAST(doc_id AS VARCHAR) AS id FROM documents),
h AS (
  SELECT r, doc_id, w0, len(w0) AS n, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(id) + 1), lambda i: [CAST(ascii(substr(id, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))) AS h FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE w0 END AS w FROM p),
g AS (
  SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] AS g
  FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM t WHERE n >= 6)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m),
runs AS (
  SELECT r, s, n, min(q) AS q FROM (SELECT r, q, min(i) AS s, count(*) + 4 + q AS n FROM isl GROUP BY r, q, k)
  WHERE n >= greatest(6, 4 * q) GROUP BY r, s, n),
said AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS said,
    first(struct_pack(s := s, n := n, q := q) ORDER BY n / q DESC, s, q) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
ws AS (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM t WHERE r IN (SELECT r FROM runs)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS c FROM ws WHERE (r, i) NOT IN (SELECT (r, i) FROM gone) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE c END) AS collapsed_sha256
FROM t LEFT JOIN said USING (r) LEFT JOIN kept USING (r)
"""
