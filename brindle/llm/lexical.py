"""Ranked lexical search: variable-block-max indexes by shard, exact search that skips blocks.

Documents are cut into shards as they are read, so no text is shuffled. A shard's index holds, for every term of the queries, its
documents in order with what the term adds to their scores. Dynamic programming chooses where each list is cut into blocks:
of all cuts, the one with the least sum of bound errors (a block's maximum less the score, over its postings) plus a fixed
charge for every block. Search goes through a shard in the order of its documents. Between two borders of blocks the sum of the
maxima of the blocks there bounds every score; the next interval whose bound reaches the threshold is taken, all others
are skipped unread. In it, lists in ascending order of their maxima give the pivots: documents of the lists from the one on with which the
sum of maxima reaches the threshold. The postings of pivots are summed exactly. The threshold is the score of the k-th best so
far, and begins at a bound for the whole corpus: the k-th best of what each shard found in its intervals of highest bounds.
Scores are integers, so bounds and results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.llm.common import blocks, discard, fresh, read, settle

# The constants of the score.
SCALE = 1_000_000_000
LENGTH_PERCENT = 90

#: What separates terms becomes a space, A-Z become small; all bytes of other characters belong to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A shard is closed at so many postings of query terms or documents, whichever comes first; it bounds a row of the index.
SHARD_POSTINGS = 1_000_000
SHARD_DOCS = 1 << 16
#: Queries are searched in blocks of so many and so many bytes of text, so that what is sent to every task is bounded.
QUERY_ROWS = 2_000
QUERY_BYTES = 4 << 20
#: Longest block. Lists are cut for certain after each CHUNK postings, which lets all lists of a shard be cut in step.
BLOCK = 64
CHUNK = 1024
#: What one more block is worth: this share of the list's greatest score.
CHARGE = 0.5
#: Cells of the tables of lists that are cut in step.
TABLE_CELLS = 1 << 20
#: Intervals that the first pass looks at for a threshold, and documents that one step of the search covers.
SEEDS = 4
STEP_DOCS = 4096
K = 10
TEXT_BYTES = 1 << 22


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased; null has none."""
    return (text or b"").translate(_TERMS).split()


def block_ends(scores: np.ndarray, lengths: np.ndarray, charge: np.ndarray, longest: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of lists (of these lengths, one after the other in scores, none empty) into blocks of at most longest postings.

    For each list, the sum over its blocks of postings * greatest - sum + charge is least. Returns the ends of all blocks as
    places in scores, and their greatest scores. Lists of like lengths advance in step, a posting a step.
    """
    order = np.argsort(-lengths, kind="stable")
    begin, ends, at = np.cumsum(lengths) - lengths, [], 0
    while at < len(order):
        group = order[at : at + max(1, TABLE_CELLS // (int(lengths[order[at]]) + longest))]
        ends.append(_cut(scores, begin[group], lengths[group], charge[group], longest))
        at += len(group)
    ends = np.sort(np.concatenate(ends))
    return ends, np.maximum.reduceat(scores, np.r_[0, ends[:-1]])


def _cut(scores: np.ndarray, begin: np.ndarray, n: np.ndarray, cost: np.ndarray, longest: int) -> np.ndarray:
    """The ends of the blocks of lists that begin in scores at begin and have n postings, longest first."""
    steps = int(n[0])
    best = np.zeros((len(n), steps + 1), dtype=np.int64)  # the least cost of a list's first j postings
    choice = np.zeros((len(n), steps + 1), dtype=np.int64)  # and the length of the last block there
    greatest = np.zeros((len(n), longest), dtype=np.int64)  # of the last 1, 2, ... postings
    total = np.zeros((len(n), longest), dtype=np.int64)
    width = np.arange(1, longest + 1)
    for j in range(1, steps + 1):
        live = int(np.searchsorted(-n, -j, "right"))
        s = scores[begin[:live] + j - 1]
        greatest[:live, 1:] = np.maximum(greatest[:live, :-1], s[:, None])
        total[:live, 1:] = total[:live, :-1] + s[:, None]
        greatest[:live, 0] = total[:live, 0] = s
        wide = min(j, longest)
        found = best[:live, j - wide : j][:, ::-1] + width[:wide] * greatest[:live, :wide] - total[:live, :wide] + cost[:live, None]
        pick = found.argmin(axis=1)
        best[:live, j], choice[:live, j] = found[np.arange(live), pick], pick + 1
    ends, at, row = [], n.copy(), np.arange(len(n))
    while len(row):
        ends.append(begin[row] + at)
        at = at - choice[row, at]
        row, at = row[at > 0], at[at > 0]
    return np.concatenate(ends)


def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of counts postings cut after each CHUNK: the pieces' lengths, and the list of each."""
    pieces = -(-counts // CHUNK)
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(CHUNK, counts[owner] - CHUNK * nth), owner


@dataclass(frozen=True)
class Shard:
    """names: term numbers, ascending; list i is docs[begin[i] : begin[i + 1]], ascending, with scores, and its blocks are
    first / last / top [cuts[i] : cuts[i + 1]]: their first and last documents and greatest scores."""

    names: np.ndarray
    begin: np.ndarray
    docs: np.ndarray
    scores: np.ndarray
    cuts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: np.ndarray

    def lists(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, query)
        return at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == query)] if len(self.names) else at[:0]


def intervals(shard: Shard, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first document, document after the last, bound) of the intervals between the borders of the lists' blocks, in order."""
    at = np.concatenate([np.arange(shard.cuts[i], shard.cuts[i + 1]) for i in lists])
    place = np.r_[shard.first[at], shard.last[at] + 1]
    order = np.argsort(place, kind="stable")
    place, bound = place[order], np.cumsum(np.r_[shard.top[at], -shard.top[at]][order])
    final = np.r_[place[1:] != place[:-1], True]
    place, bound = place[final], bound[final]
    return place[:-1], place[1:], bound[:-1]


def _summed(shard: Shard, lists: np.ndarray, low: int, high: int, wanted: np.ndarray) -> np.ndarray:
    """The scores of documents low to high - 1; only those of wanted are summed."""
    out = np.zeros(high - low, dtype=np.int64)
    for i in lists:
        a, b = shard.begin[i], shard.begin[i + 1]
        x, y = a + np.searchsorted(shard.docs[a:b], [low, high])
        d = shard.docs[x:y] - low
        ok = wanted[d]
        out[d[ok]] += shard.scores[x:y][ok]  # a list has a document once
    return out


def _pivots(shard: Shard, lists: np.ndarray, low: int, high: int, need: int) -> np.ndarray:
    """Which of the documents low to high - 1 can score need: those of the lists that, in ascending order of their greatest
    score there, bring the sum of these to need. A document of the lists before alone stays below it."""
    top = np.zeros(len(lists), dtype=np.int64)
    for k, i in enumerate(lists):
        a, b = shard.cuts[i], shard.cuts[i + 1]
        x, y = a + np.searchsorted(shard.last[a:b], low), a + np.searchsorted(shard.first[a:b], high)
        top[k] = shard.top[x:y].max() if x < y else 0
    order = np.argsort(top, kind="stable")
    out = np.zeros(high - low, dtype=bool)
    for i in lists[order[np.cumsum(top[order]) >= need]]:
        a, b = shard.begin[i], shard.begin[i + 1]
        x, y = a + np.searchsorted(shard.docs[a:b], [low, high])
        out[shard.docs[x:y] - low] = True
    return out


def _merge(best: list[np.ndarray], docs: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of best and these, ties to the earlier document."""
    d, s = np.r_[best[0], docs], np.r_[best[1], scores]
    order = np.lexsort((d, -s))[:k]
    return [d[order], s[order]]


def search_shard(shard: Shard, query: np.ndarray, k: int, least: int = 1, seeds: int | None = None) -> tuple[list[np.ndarray], int]:
    """The k best (documents, scores) of a shard for a query's term numbers, scores of least or more, ties to the earlier
    document; and the number of documents whose scores were summed. With seeds, only that many intervals of highest bounds."""
    lists, best, looked = shard.lists(query), [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)], 0
    if not len(lists):
        return best, 0
    low, high, bound = intervals(shard, lists)
    if seeds is not None:
        pick = np.sort(np.argsort(-bound, kind="stable")[:seeds])
    else:
        pick = np.flatnonzero(bound >= max(1, least))
    at = 0
    while at < len(pick):
        # the k-th best so far is of an earlier document, so a later one must exceed it
        need = max(1, least, int(best[1][-1]) + 1 if len(best[1]) == k and seeds is None else 1)
        pivot = at + int(np.argmax(bound[pick[at:]] >= need))
        if bound[pick[pivot]] < need:
            break
        start = int(low[pick[pivot]])
        stop = max(pivot + 1, int(np.searchsorted(high[pick], start + STEP_DOCS, "right")))
        group = pick[pivot:stop]
        group = group[bound[group] >= need]
        end, step = int(high[group[-1]]), np.zeros(int(high[group[-1]]) - start + 1, dtype=np.int64)
        np.add.at(step, low[group] - start, 1)
        np.add.at(step, high[group] - start, -1)
        wanted = (np.cumsum(step)[:-1] > 0) & _pivots(shard, lists, start, end, need)
        scores = _summed(shard, lists, start, end, wanted)
        found = np.flatnonzero(scores >= need)
        best, looked, at = _merge(best, found + start, scores[found], k), looked + int(wanted.sum()), stop
    return best, looked


_RAW = "ids array<{kind}>, m array<bigint>, names binary, counts binary, docs binary, tf binary, n bigint, l bigint"
_INDEX = "ids array<{kind}>, names binary, begin binary, docs binary, scores binary, cuts binary, first binary, last binary, top binary"


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each shard: the ids and lengths of its documents, and for each term of the vocabulary in it, in the order
    of their numbers, the documents and frequencies; n and l count documents and terms, also of what holds no query term."""
    field = docs.schema[id_col]
    kind = to_arrow_type(field.dataType)
    names = ["ids", "m", "names", "counts", "docs", "tf", "n", "l"]

    def row(ids: list, lengths: list[int], term: list[np.ndarray], doc: list[np.ndarray], tf: list[np.ndarray], n: int, total: int) -> pa.RecordBatch:
        t, d, f = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (term, doc, tf))
        named = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))  # a shard's documents go by id, as ties do
        place = np.empty(len(ids), dtype=np.int64)
        place[named] = np.arange(len(ids))
        ids, lengths, d = [ids[i] for i in named], [lengths[i] for i in named], place[d]
        order = np.lexsort((d, t))
        found, counts = np.unique(t, return_counts=True)
        data = [x.astype(y).tobytes() for x, y in ((found, "<i4"), (counts, "<i4"), (d[order], "<i4"), (f[order], "<i8"))]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in data], pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, term, doc, tf, n, total, size = [], [], [], [], [], 0, 0, 0
        for batch in batches:
            for part in blocks(batch, 1, TEXT_BYTES):
                for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = terms(text.as_py())
                    n, total = n + bool(found), total + len(found)
                    known = np.array([vocabulary[t] for t in found if t in vocabulary], dtype=np.int64)
                    if len(known):
                        t, f = np.unique(known, return_counts=True)
                        term.append(t)
                        tf.append(f)
                        doc.append(np.full(len(t), len(ids)))
                        ids.append(name)
                        lengths.append(len(found))
                        size += len(t)
                    if size >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                        yield row(ids, lengths, term, doc, tf, n, total)
                        ids, lengths, term, doc, tf, n, total, size = [], [], [], [], [], 0, 0, 0
        if n:
            yield row(ids, lengths, term, doc, tf, n, total)

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return slim.mapInArrow(run, _RAW.format(kind=field.dataType.simpleString()))


def _frequencies(raw: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of size terms: a row a term comes to the driver, a block of queries bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, counts in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names.as_py(), "<i4")), pa.array(np.frombuffer(counts.as_py(), "<i4").astype(np.int64))], names=["term", "df"])

    n, total = raw.agg(F.sum("n"), F.sum("l")).first()
    df = np.zeros(size, dtype=np.int64)
    for r in raw.select("names", "counts").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return n or 0, total or 0, df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _indexed(raw: DataFrame, n: int, total: int, weights: np.ndarray) -> DataFrame:
    """The index rows of the shards."""
    kind = raw.schema["ids"].dataType.elementType.simpleString()

    def row(lengths: np.ndarray, names: np.ndarray, counts: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> list:
        m = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * int(x) * n // total for x in lengths], dtype=np.int64)
        scores = np.repeat(weights[names], counts) * ((SCALE * tf) // (1000 * tf + 8 * m[docs]))
        pieces, owner = _chunks(counts.astype(np.int64))
        greatest = np.maximum.reduceat(scores, np.cumsum(counts) - counts) if len(counts) else scores
        ends, top = block_ends(scores, pieces, (CHARGE * greatest[owner]).astype(np.int64)) if len(pieces) else (np.zeros(0, dtype=np.int64), scores)
        begin = np.r_[0, np.cumsum(counts)]
        cuts = np.searchsorted(ends, begin[1:], "right")
        first, last = docs[np.r_[0, ends[:-1]].astype(np.int64)] if len(ends) else docs, docs[ends - 1]
        return [x.astype(y).tobytes() for x, y in ((names, "<i4"), (begin, "<i8"), (docs, "<i4"), (scores, "<i8"), (np.r_[0, cuts], "<i8"), (first, "<i4"), (last, "<i4"), (top, "<i8"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                parts = [np.frombuffer(one.column(j)[0].as_py(), t) for j, t in ((2, "<i4"), (3, "<i4"), (4, "<i4"), (5, "<i8"))]
                lengths = one.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([one.column(0), *[pa.array([x], pa.binary()) for x in row(lengths, *parts)]], names=["ids", "names", "begin", "docs", "scores", "cuts", "first", "last", "top"])

    return raw.select("ids", "m", "names", "counts", "docs", "tf").mapInArrow(run, _INDEX.format(kind=kind))


def _found(index: DataFrame, queries: list[np.ndarray], k: int, least: np.ndarray, seeds: int | None = None) -> DataFrame:
    """(query, id, score): of each shard and query the k best; queries go by their place in the block."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = [np.frombuffer(b.column(j + 1)[i].as_py(), t) for j, t in enumerate(("<i4", "<i8", "<i4", "<i8", "<i8", "<i4", "<i4", "<i8"))]
                shard = Shard(*[x.astype(np.int64) for x in parts])
                ids = b.column(0)[i].values
                number, docs, scores = [], [], []
                for q, query in enumerate(queries):
                    best, _ = search_shard(shard, query, k, int(least[q]), seeds)
                    number.append(np.full(len(best[0]), q))
                    docs.append(best[0])
                    scores.append(best[1])
                if number:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=["query", "id", "score"])

    return index.mapInArrow(run, f"query bigint, id {kind}, score bigint")


def _query_blocks(queries: DataFrame, text_col: str) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Blocks of (numbers, terms) of queries; a partition at a time comes to the driver."""
    numbers, found, size = [], [], 0
    for r in queries.select("_query", F.col(f"`{text_col}`").cast("binary").alias("t")).toLocalIterator():
        if numbers and (len(numbers) >= QUERY_ROWS or size + len(r["t"] or b"") > QUERY_BYTES):
            yield numbers, found
            numbers, found, size = [], [], 0
        numbers.append(r["_query"])
        found.append(sorted(set(terms(bytes(r["t"] or b"")))))
        size += len(r["t"] or b"")
    if numbers:
        yield numbers, found


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, id_col, score): for each row of queries its k highest-scoring rows of docs, scores above 0, ties to the smaller id.

    Null and empty texts hold no terms: such documents count nowhere, such queries find nothing. Repeated rows of docs are
    documents of their own and may fill several ranks; of equal scores a null id comes last. Whole repeated rows of queries are
    one query; rows that share an id with another text are ranked each on their own. Empty tables give an empty table. Texts of
    any length are taken whole, other columns are not read, and where the id columns share a name, or have that of a
    result, the result's gets underscores. Scores must stay below 2^63, which holds below 9 * 10^9 occurrences in a document.
    """
    spark = docs.sparkSession
    numbered = settle(queries.select(F.col(f"`{query_id}`").alias("_item"), F.col(f"`{query_text}`").alias("_text")).distinct().withColumn("_query", F.monotonically_increasing_id()))
    out = None
    for numbers, found in _query_blocks(numbered, "_text"):
        vocabulary = {t: i for i, t in enumerate(sorted({t for q in found for t in q}))}
        wanted = [np.array([vocabulary[t] for t in q], dtype=np.int64) for q in found]
        raw = settle(_postings(docs, id_col, text_col, vocabulary))
        n, total, df = _frequencies(raw, len(vocabulary))
        index = settle(_indexed(raw, n, total, np.array([weight(n, x) if x else 0 for x in df.tolist()], dtype=np.int64)))
        discard(raw)
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)  # noqa: E731, B023
        least = np.ones(len(numbers), dtype=np.int64)
        for r in ranked(_found(index, wanted, k, least, SEEDS)).where(F.col("rank") == k).collect():  # a row a query of the block
            least[r["query"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(numbers)), "query bigint, _query bigint")
        hits = settle(ranked(_found(index, wanted, k, least)).join(names, "query").select("_query", "rank", "id", "score"))
        discard(index)
        out = hits if out is None else out.unionByName(hits)
    kind = docs.schema[id_col].dataType.simpleString()
    if out is None:
        out = spark.createDataFrame([], f"_query bigint, rank int, id {kind}, score bigint")
    first = fresh(["rank", "score"], query_id)
    second = fresh(["rank", "score", first], id_col)
    return out.join(numbered, "_query").select(F.col("_item").alias(first), F.col("rank").cast("int"), F.col("id").alias(second), "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * s.n) // s.l AS m FROM t, s WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
