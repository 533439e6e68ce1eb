"""Exact substring deduplication with repeated-phrase automata.

A window is `window` consecutive words. A window is removed if the same words also start earlier: in a document with a
smaller id, or earlier in the same document. Every word that a removed window covers goes.

1. Confirm. Each window names one of its five-word phrases, the first with the least hash. Equal windows name equal phrases,
   so a phrase that is named once in the whole corpus belongs to no recurring window. Counting named phrases (one for
   about eight words) confirms the recurring ones; one occurrence, wherever in the corpus, gives a phrase's bytes.
2. Compile and stream. Documents are dealt into shards by how they open, so that copies meet in a shard. A shard is sent the bytes of the confirmed phrases that are
   named in it, compiles them into an Aho-Corasick automaton and streams every one of its documents through it. What the
   automaton locates, byte for byte, are the occurrences; a window is a candidate if the phrase it names is located.
3. Settle. A shard gives each of its distinct candidate windows, by two independent 64-bit hashes of all of its words, a
   first place. Equal windows name equal phrases, so only windows whose phrase is named in several shards leave theirs; they
   meet by their hashes, and a shard is told which of its first places are later than another's. A candidate at such a
   place, or elsewhere than at its shard's first place, is removed.

No stage gathers the places of a phrase or a window: a shard counts its own first, and what a shard holds grows with its
own documents only. A passage in every document is one row a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import blocks, discard, fresh, read, release, settle, words

WINDOW = 20
PHRASE = 5
#: Bytes of text whose phrases are counted together before they are sent on.
BLOCK_BYTES = 2 << 20
#: Low bits of a phrase's hash that give way to its place; longer texts are searched in overlapping parts.
PLACE_BITS = 24
#: Candidate windows that a shard's task holds before it reduces them to first places.
HELD_WINDOWS = 400_000
#: Bytes of text that one shard holds, about; a shard's automaton is compiled from these documents' phrases alone.
SHARD_BYTES = 4_000_000
#: At least so many shards, so that a small table still spreads.
MIN_SHARDS = 48
#: Documents are dealt by a hash of so many first characters: copies mostly open alike. It decides where work is done, not what is found.
ROUTE_CHARS = 64
#: Ids are below this; rows without a number come after all others, by a hash.
NO_ID = 1 << 62

# Odd multipliers of the rolling hashes.
_P1 = 0x9E3779B97F4A7C15
_P2 = 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _power(base: int, k: int) -> np.uint64:
    return np.uint64(pow(base, k, 1 << 64))


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


def _rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of each run of width hashes, put together from runs of 1, 2, 4, ... hashes."""
    n, at, run, size = len(h) - width + 1, 0, h, 1
    out = np.zeros(n, dtype=np.uint64)
    while True:
        if width & size:
            out += run[at : at + n] * _power(base, at)
            at += size
        if 2 * size > width:
            return out
        run, size = run[:-size] + run[size:] * _power(base, size), 2 * size


def _phrase_hashes(h: np.ndarray, phrase: int) -> np.ndarray:
    g = _rolled(h, phrase, _P1)
    g ^= g >> np.uint64(33)
    g *= _MIX
    g ^= g >> np.uint64(29)
    return g


def named(g: np.ndarray, span: int) -> np.ndarray:
    """For each window, where the phrase it names starts: the first of its span phrases whose hash is least in its upper bits."""
    n = len(g) - span + 1
    if len(g) > 1 << PLACE_BITS:
        return np.concatenate([named(g[i : i + (1 << PLACE_BITS)], span) + i for i in range(0, n, (1 << PLACE_BITS) - span + 1)])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, width = g & ~low | np.arange(len(g), dtype=np.uint64), 1
    while 2 * width <= span:  # the least of runs of 2, 4, 8, ... places
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return (np.minimum(least[:n], least[span - width : span - width + n]) & low).astype(np.int64)


def _steps(a: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def _named_phrases(window: int, phrase: int, hash_bits: int = 64):
    """(h, shard, n, t): the phrases that a shard's texts name, by the first hash_bits of a hash, how often, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1, BLOCK_BYTES):
                found, texts = [], []
                for shard, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = t.split()
                    if len(w) < window:
                        continue
                    g = _phrase_hashes(word_hashes(w), phrase)
                    at = _steps(named(g, window - phrase + 1))
                    rows = np.zeros(len(at), dtype=[("h", "<u8"), ("p", "<i4"), ("text", "<i4"), ("at", "<i4")])
                    rows["h"], rows["p"], rows["text"], rows["at"] = g[at] >> np.uint64(64 - hash_bits), shard, len(texts), at
                    found.append(rows)
                    texts.append(w)
                if not found:
                    continue
                rows = np.concatenate(found)
                rows = rows[np.lexsort((rows["p"], rows["h"]))]
                first = np.flatnonzero(np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["p"][1:] != rows["p"][:-1])])
                n = np.diff(np.r_[first, len(rows)])
                again = np.ones(len(rows), dtype=bool)
                again[first] = False
                every, rows = rows, rows[first]
                said = [b" ".join(texts[i][j : j + phrase]) for i, j in zip(rows["text"].tolist(), rows["at"].tolist(), strict=True)]
                # unlike phrases of one hash are rows of their own; their occurrences are counted already
                others = {(k, b" ".join(texts[i][j : j + phrase])) for k, i, j in zip(np.repeat(np.arange(len(first)), n)[again].tolist(), every["text"][again].tolist(), every["at"][again].tolist(), strict=True)}
                more = [(k, t) for k, t in others if t != said[k]]
                kept = np.r_[np.arange(len(rows)), np.array([k for k, _ in more], dtype=np.int64)]
                n = np.r_[n, np.zeros(len(more), dtype=np.int64)]
                said += [t for _, t in more]
                yield pa.RecordBatch.from_arrays([pa.array(rows["h"][kept].view(np.int64)), pa.array(rows["p"][kept]), pa.array(n.astype(np.int32)), pa.array(said, pa.binary())], names=["h", "shard", "n", "t"])

    return run


_FOUND = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.binary()), ("again", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32())])
#: Values of an automaton's phrases: named in this shard only, or in others too.
HERE, WIDE = 1, 2


def _located(line: bytes, n: int, automaton: ahocorasick.Automaton, phrase: int) -> np.ndarray:
    """The value of the automaton's phrase that starts at each of the n words, or 0; line is the words between single spaces."""
    met = np.fromiter(chain.from_iterable(automaton.iter(line.decode("latin-1"))), dtype=np.int64)
    blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    out = np.zeros(n + 1, dtype=np.int8)
    out[np.searchsorted(blanks, met[::2]) - phrase] = met[1::2]
    return out


def _candidates(window: int, phrase: int):
    """Compiles the phrases that a shard was sent and streams its documents through the automaton.

    Ranges travel as bytes: Spark's Arrow writer measures a list column anew for every row.

    Gives, for each text with a candidate, the ranges of its candidate window starts (start, end, start, end, ...) and of
    those among them that are not the window's first place in the shard, and for each distinct candidate window that other
    shards may hold its hashes and first place here.
    """
    span = window - phrase + 1

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        if not docs.num_rows or not confirmed.num_rows:
            return _FOUND.empty_table()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        wide = confirmed.column("wide").to_pylist() if "wide" in confirmed.column_names else [True] * confirmed.num_rows
        for t, w in zip(confirmed.column("t"), wide, strict=True):
            automaton.add_word((b" " + t.as_py() + b" ").decode("latin-1"), WIDE if w else HERE)
        automaton.make_automaton()
        parts, firsts, held = [], None, 0
        seen: set[tuple[int, int]] = set()
        whole = []
        texts = docs.column("t")
        for i, (key, h, t) in enumerate(zip(docs.column("key").to_pylist(), docs.column("text_hash").to_pylist(), texts, strict=True)):
            if (key, h) in seen:
                continue  # the same row again: nothing new
            seen.add((key, h))
            w = t.as_py().split()
            if len(w) < window:
                continue
            there = _located(b" " + b" ".join(w) + b" ", len(w), automaton, phrase)
            if not there.any():
                continue
            words_ = word_hashes(w)
            value = there[named(_phrase_hashes(words_, phrase), span)]
            at = np.flatnonzero(value).astype(np.int32)
            if not len(at):
                continue
            whole.append((key, h, _ranges(value > 0), i))
            rows = _windows(words_, at, window, key)
            rows["wide"] = value[at] == WIDE
            parts.append(rows)
            held += len(at)
            if held > HELD_WINDOWS:
                firsts, parts, held = _first_places([*([] if firsts is None else [firsts]), *parts]), [], 0
        if not whole:
            return _FOUND.empty_table()
        rows = _first_places([*([] if firsts is None else [firsts]), *parts])
        by_key, texts_of = _by_key(rows["key"], rows["start"], rows["a"]), _counts(key for key, *_ in whole)
        again = []
        for key, _, spans, i in whole:
            at, (first, hashed) = _starts(spans), by_key.get(key, _NO_PLACES)
            other = np.zeros(at[-1] + 1, dtype=bool)
            other[at] = True
            if texts_of[key] > 1:  # texts that share an id: a place is this text's only if the window there is
                own = _windows(word_hashes(texts[i].as_py().split()), at, window, key)["a"]
                pairs = set(zip(first.tolist(), hashed.tolist(), strict=True))
                other[at[[p in pairs for p in zip(at.tolist(), own.tolist(), strict=True)]]] = False
            else:
                other[first] = False
            again.append(_ranges(other))
        rows = rows[rows["wide"]]
        none, blank, here = len(whole), len(rows), docs.column("shard")[0].as_py()
        spans = pa.table([pa.array(np.full(none, here, dtype=np.int32)), pa.array([x[0] for x in whole], pa.int64()), pa.array([x[1] for x in whole], pa.int64()), pa.array([x[2] for x in whole], pa.binary()), pa.array(again, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32())], schema=_FOUND)
        windows = pa.table([pa.array(np.full(blank, here, dtype=np.int32)), pa.array(rows["key"].copy()), pa.nulls(blank, pa.int64()), pa.nulls(blank, pa.binary()), pa.nulls(blank, pa.binary()), pa.array(rows["a"].copy()), pa.array(rows["b"].copy()), pa.array(rows["start"].copy())], schema=_FOUND)
        return pa.concat_tables([spans, windows])

    return run


def _windows(h: np.ndarray, at: np.ndarray, window: int, key: int) -> np.ndarray:
    """A row for each window that starts at one of at: two independent 64-bit hashes and the place."""
    rows = np.zeros(len(at), dtype=[("a", "<i8"), ("b", "<i8"), ("key", "<i8"), ("start", "<i4"), ("wide", "?")])
    rows["a"], rows["b"] = _rolled(h, window, _P1)[at].view(np.int64), _rolled(h, window, _P2)[at].view(np.int64)
    rows["key"], rows["start"] = key, at
    return rows


def _first_places(parts: list[np.ndarray]) -> np.ndarray:
    """The row of each window's first place; windows that are met once need no further order."""
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows["a"])]
    same = rows["a"][1:] == rows["a"][:-1]
    more = np.r_[False, same] | np.r_[same, False] if len(rows) > 1 else np.zeros(len(rows), dtype=bool)
    once, rows = rows[~more], rows[more]
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["b"], rows["a"]))]
    first = np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])] if len(rows) else np.zeros(0, dtype=bool)
    return np.concatenate([once, rows[first]])


_NO_PLACES = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)


def _by_key(keys: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The starts and hashes of each key."""
    order = np.argsort(keys, kind="stable")
    keys, starts, hashes = keys[order], starts[order], hashes[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, dtype=np.int64)
    return {int(keys[i]): (starts[i:j], hashes[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}


def _counts(keys: Iterator[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k in keys:
        out[k] = out.get(k, 0) + 1
    return out


def _ranges(mark: np.ndarray) -> bytes:
    """Where the marked ranges start and end: start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0])).astype("<i4").tobytes()


def _starts(spans: bytes) -> np.ndarray:
    edges = np.frombuffer(spans, dtype="<i4").tolist()
    return np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in zip(edges[::2], edges[1::2], strict=True)])


def cut(t: bytes, gone: np.ndarray) -> bytes:
    """t without the words that gone marks; each takes the white space behind it along."""
    out, at, i, n = [], 0, 0, len(gone)
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    ends = _word_starts(t, n)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(t[at : ends[a]])
        at = ends[b] if b < n else len(t)
    out.append(t[at:])
    return b"".join(out)


def _word_starts(t: bytes, n: int) -> np.ndarray:
    """The byte at which each of the n words of t starts."""
    raw = np.frombuffer(t, dtype=np.uint8)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    assert len(starts) == n
    return starts


def _cut_repeats(window: int, text_at: int, names: list[str]):
    """From a shard's documents and what is known of it (ranges of windows met again, first places that are later than another shard's), the documents with n_words, n_removed and the text left."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        ranges, later = {}, {}
        if known.num_rows:
            is_text = known.column("again").is_valid()
            of = known.filter(is_text)
            ranges = {(k, h): s for k, h, s in zip(of.column("key").to_pylist(), of.column("text_hash").to_pylist(), of.column("again").to_pylist(), strict=True)}
            of = known.filter(pc.invert(is_text))
            later = _by_key(*(of.column(c).to_numpy() for c in ("key", "start", "a")))
        texts_of = _counts(k for k, _ in ranges)
        texts, n_words, n_removed, n_cols = [], [], [], docs.num_columns
        rows = zip((t.as_py() for t in docs.column(text_at).cast(pa.binary())), docs.column(n_cols - 3).to_pylist(), docs.column(n_cols - 1).to_pylist(), strict=True)
        for t, key, h in rows:
            w = (t or b"").split()
            n, gone, mine = len(w), None, ranges.get((key, h))
            if mine is not None:
                at, hashed = later.get(key, _NO_PLACES)
                if len(at) and texts_of[key] > 1:  # texts that share an id: a place is this text's only if the window there is
                    at, hashed = at[at <= n - window], hashed[at <= n - window]
                    at = at[_windows(word_hashes(w), at, window, key)["a"] == hashed]
                if mine or len(at):
                    edge = np.zeros(n + 1, dtype=np.int32)
                    met = np.frombuffer(mine, dtype="<i4")
                    edge[met[::2]] += 1
                    edge[met[1::2] - 1 + window] -= 1
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
            cuts = gone is not None and bool(gone.any())
            texts.append(cut(t, gone) if cuts else t)
            n_words.append(n)
            n_removed.append(int(gone.sum()) if cuts else 0)
        out = docs.set_column(text_at, names[text_at], pa.array(texts, type=pa.binary()).cast(pa.string()))
        out = out.select(range(len(names)))
        return out.append_column("n_words", pa.array(n_words, type=pa.int64())).append_column("n_removed", pa.array(n_removed, type=pa.int64()))

    return run


def doc_key(id_col: str, text_col: str, kind: T.DataType) -> Column:
    """The long by which documents are earlier or later: a whole number's value; of any other id, and of rows without one, a hash behind all numbers."""
    hashed = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return F.coalesce(F.col(id_col).cast("long"), hashed) if isinstance(kind, T.IntegralType) else hashed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, hash_bits: int = 64) -> DataFrame:
    """docs with the repeated passages cut from text, and n_words (before) and n_removed as last columns.

    Columns of docs with these two names are replaced; all others are kept. Null texts have no words and stay null; empty
    and short texts lose nothing. Rows that share an id count as one document: at equal starts neither is earlier. Ids are
    whole numbers below 2^62; ids of other types, and rows with a null id, come in the order of a hash (of the id, or of the
    text), after all numbers; among equal texts without an id nothing is removed. An empty table gives an empty table. Texts
    may be of any length: a task holds a shard's texts and phrases, and a longer text is a shard's only one. Phrases are counted by
    hash_bits of a hash; with fewer bits more phrases are looked for, and the result is the same.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed")])
    names = docs.columns
    key, shard, text_hash, hr, hr2, n_parts, hk, n_salts = (fresh(names, x) for x in ("_key", "_shard", "_text_hash", "_route", "_own_route", "_parts", "_id", "_salts"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(MIN_SHARDS, -(-total // shard_bytes))
    keyed = docs.withColumn(key, doc_key(id_col, text_col, docs.schema[id_col].dataType))
    body = F.coalesce(F.col(text_col), F.lit(""))
    route, number = F.xxhash64(F.substring(body, 1, ROUTE_CHARS)), F.xxhash64(body)
    slim = settle(keyed.select(F.col(key).alias("key"), route.alias("route"), F.octet_length(body).cast("long").alias("size")))
    parts = F.ceil(F.sum("size") / shard_bytes)
    # openings of more than a shard of text are dealt by id; ids whose texts open differently are dealt by id, and if they fill more than a shard, by text
    heavy = settle(slim.groupBy(F.col("route").alias(hr)).agg(F.sum("size").alias("size"), parts.alias(n_parts)).where(F.col("size") > shard_bytes).select(hr, n_parts))
    split = settle(slim.groupBy(F.col("key").alias(hk)).agg(F.min("route").alias("lo"), F.max("route").alias("hi"), F.greatest(F.lit(1), parts).alias(n_salts)).where("lo <> hi").select(hk, n_salts))
    any_heavy, any_split = not heavy.isEmpty(), not split.isEmpty()
    discard(slim)
    place = lambda k, s: F.pmod(F.xxhash64(k, s.cast("long")), F.lit(shards)).cast("int")
    dealt, here = keyed, place(route, F.lit(0))
    if any_heavy:
        dealt = dealt.withColumn(hr2, route).join(heavy, F.col(hr2) == F.col(hr), "left")
        here = place(route, F.coalesce(F.pmod(F.xxhash64(key), F.col(n_parts)), F.lit(0)))
    if any_split:
        dealt = dealt.join(split, F.col(key) == F.col(hk), "left")
        here = F.when(F.col(hk).isNull(), here).otherwise(place(F.col(key), F.pmod(number, F.col(n_salts))))
    dealt = dealt.select(*names, key, here.alias(shard), number.alias(text_hash))

    texts = dealt.where(F.col(text_col).isNotNull()).select(F.col(shard).alias("shard"), F.col(text_col).cast("binary").alias("t"), F.col(key).alias("key"), F.col(text_hash).alias("text_hash"))
    phrases = settle(texts.select("shard", "t").mapInArrow(_named_phrases(window, phrase, hash_bits), "h long, shard int, n int, t binary"))
    # by hash: unlike phrases of one hash are all looked for, each where it is named
    recurring = phrases.groupBy("h").agg(F.sum("n").alias("n"), (F.min("shard") < F.max("shard")).alias("wide")).where("n > 1").select("h", "wide")
    confirmed = settle(phrases.join(recurring, "h").select("shard", "t", "wide"))
    discard(phrases)

    located = texts.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(_candidates(window, phrase), "shard int, key long, text_hash long, spans binary, again binary, a long, b long, start int")
    found = settle(located)
    discard(confirmed)
    in_order = Window.partitionBy("a", "b").orderBy("key", "start")  # of each window, at most one row a shard
    firsts = found.where("spans IS NULL").select("shard", "key", "start", "a", F.first("key").over(in_order).alias("k"), F.first("start").over(in_order).alias("s"))
    later = firsts.where("key <> k OR start <> s").select("shard", "key", "start", "a")
    again = found.where("spans IS NOT NULL").select("shard", "key", "text_hash", "again")
    known = settle(later.unionByName(again, allowMissingColumns=True))
    discard(found)
    release(docs.sparkSession)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cutter = _cut_repeats(window, names.index(text_col), names)
    return dealt.groupBy(shard).cogroup(known.groupBy("shard")).applyInArrow(cutter, f"{kinds}, n_words long, n_removed long")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(words(F.col("text")), " ")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
