"""SentencePiece encoding with seeded merge-dropout, and decoding.

A pre-token starts as its characters. Candidate merges of neighbours wait in an agenda, best score first, then leftmost.
A candidate that is taken from the agenda is skipped with the probability of the dropout; else it merges and its new
neighbours join the agenda. Every occurrence draws its own skips, from a keyed hash of the seed, the document, the pass and
the occurrence's place; any rerun repeats them. What is drawn are the numbers of candidates from one skip to the next. The
agenda is the same up to the first skip, so the cuts of a pre-token form a tree: a child has one more skip, by its place.
A worker walks the trees of all occurrences of a block together and processes the agendas of cuts that it has not met in
lockstep. With dropout 0 the ids are the library's own. Characters without a piece, and those of the mark itself, are
written as bytes, so decoding returns every text unchanged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import blocks, fresh, read
from brindle.llm.pieces import DEFAULT_MODEL, Pieces, load, pieces, pre_tokens

DROPOUT = 0.1
SEED = 29
#: Bytes of segmentations that a worker remembers; a block's own come on top until the next one begins.
CACHE_BYTES = 40 << 20
#: Bytes of text that are cut together.
BLOCK_BYTES = 2 << 20
#: Pre-tokens of more characters are cut by themselves and not remembered.
LONGEST = 48
#: Pre-tokens whose agendas run in one lockstep.
LOCKSTEP = 8_192

_M64 = (1 << 64) - 1
_NEVER = 1 << 62
_NONE = 1 << 30
# The constants of splitmix64.
_STEP, _X, _Y = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(x: int) -> int:
    x = (x ^ x >> 30) * _X & _M64
    x = (x ^ x >> 27) * _Y & _M64
    return x ^ x >> 31


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_X)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_Y)
    return x ^ x >> np.uint64(31)


def _scale(dropout: float) -> float:
    """1 / log(1 - dropout): log(u) times this, rounded down, is a geometric draw; next to 0 if all are skipped."""
    return 1 / math.log1p(-dropout) if dropout < 1 else -1e-300


def _gaps(x: np.ndarray, scale: float) -> np.ndarray:
    """Candidates kept before a skip, one draw for each hash."""
    return np.minimum(np.log(((x >> np.uint64(11)) + 1.0) * 2.0**-53) * scale, 2.0**40).astype(np.int64)


def _skips(x: int, at: int, scale: float) -> Iterator[int]:
    """Places of skips after the place at, from the hash x on."""
    while True:
        x = _mixed((x + _STEP) & _M64)
        at += 1 + min(int(math.log(((x >> 11) + 1.0) * 2.0**-53) * scale), 1 << 40)
        yield at


def segment(token: str, vocab: Pieces, dropout: float = 0.0, key: int = 0) -> list[int]:
    """The ids of one pre-token; key is the hash that its skips are drawn from."""
    return cut(token, vocab, _skips(_mixed(key & _M64), -1, _scale(dropout)) if dropout else iter((_NEVER,)))[0]


def cut(token: str, vocab: Pieces, skips: Iterator[int]) -> tuple[list[int], int]:
    """The ids of one pre-token, and how many candidates were taken from its agenda; skips are the places of those skipped.

    An agenda entry is one integer: the merged piece's rank, the start and the end of its span, from high bits to low.
    """
    ids, ranks, n = vocab.ids, vocab.ranks, len(token)
    if n == 1:
        whole = ids.get(token)
        return ([whole] if whole is not None else vocab.fallback(token)), 0
    skip, place = next(skips), -1
    shift = max(16, n.bit_length())
    low = (1 << shift) - 1
    ends = list(range(1, n + 1))  # of the symbol that starts here; 0: it was merged into one to the left
    before = list(range(-1, n - 1))  # start of the symbol to the left
    agenda = []
    for i in range(n - 1):
        rank = ranks.get(token[i : i + 2])
        if rank is not None:
            agenda.append((rank << shift | i) << shift | i + 2)
    heapq.heapify(agenda)
    pop, push = heapq.heappop, heapq.heappush
    while agenda:
        code = pop(agenda)
        e, a = code & low, code >> shift & low
        m = ends[a]
        if not m or m >= e or ends[m] != e:
            continue
        place += 1
        if place == skip:
            skip = next(skips)
            continue
        ends[a], ends[m] = e, 0
        if e < n:
            before[e] = a
            end = ends[e]
            rank = ranks.get(token[a:end])
            if rank is not None:
                push(agenda, (rank << shift | a) << shift | end)
        left = before[a]
        if left >= 0:
            rank = ranks.get(token[left:e])
            if rank is not None:
                push(agenda, (rank << shift | left) << shift | e)
    out, at = [], 0
    while at < n:
        end = ends[at]
        got = ids.get(token[at:end])
        if got is None:
            out += vocab.fallback(token[at])
        else:
            out.append(got)
        at = end
    return out, place + 1


class Merges:
    """The vocabulary as arrays: symbol ids (a piece's rank; UNKNOWN for a character without a piece) and a hash table from two neighbouring symbols to the piece they merge to."""

    def __init__(self, vocab: Pieces) -> None:
        ranks = vocab.ranks
        self.unknown = len(ranks)
        self.piece_ids = np.array([vocab.ids[p] for p in ranks], dtype=np.int32)
        chars = sorted((ord(p), r) for p, r in ranks.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in chars], dtype=np.uint32)
        self.char_ranks = np.array([r for _, r in chars], dtype=np.int32)
        found = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        left, right, self_rank = (np.array(c, dtype=np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        keys, self.bits = left * (self.unknown + 1) + right, max(4, (4 * len(found)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, _NONE, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing, all keys at once: the last to write a slot keeps it
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        self.merged[at] = self_rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each left and right merge to, _NONE if there is none."""
        keys = left.astype(np.int64) * (self.unknown + 1) + right
        at = self._slot(keys)
        seen = self.keys[at]
        lost = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(lost):
            at[lost] = at[lost] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[lost]]
            lost = lost[(seen != keys[lost]) & (seen >= 0)]
        return np.where(self.keys[at] == keys, self.merged[at], _NONE)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, codes), max(0, len(self.chars) - 1))
        return np.where(self.chars[at] == codes, self.char_ranks[at], self.unknown) if len(self.chars) else np.full(codes.shape, self.unknown)


def cut_all(tokens: list[str], paths: np.ndarray, vocab: Pieces, merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids one behind the other, how many each token has, candidates taken): cut() of many tokens of at most LONGEST characters in lockstep.

    A row of paths holds the places of a token's skips. In each step every token takes the best candidate of its agenda,
    which is an array: a candidate's rank and place by the place where it starts.
    """
    n, size = len(tokens), np.fromiter(map(len, tokens), dtype=np.int32, count=len(tokens))
    width = int(size.max())
    codes = np.array(tokens, dtype=f"<U{width}").view(np.uint32).reshape(n, width).T
    sym = merges.symbols(codes).astype(np.int32)
    inside = np.arange(width)[:, None] < size
    place_bits = np.int64(width.bit_length())
    nxt = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32)[:, None], (width, n)).copy()
    prv = nxt - 2
    none = _NONE << int(place_bits)
    agenda = np.full((width, n), none, dtype=np.int64)
    if width > 1:
        first = merges.ranks(sym[:-1].ravel(), sym[1:].ravel()).reshape(width - 1, n)
        at = np.broadcast_to(np.arange(width - 1)[:, None], first.shape)
        agenda[:-1] = np.where((first < _NONE) & inside[1:], first.astype(np.int64) << place_bits | at, none)
    flat_sym, flat_nxt, flat_prv, starts = sym.ravel(), nxt.ravel(), prv.ravel(), inside.copy().ravel()
    taken, flat, step = np.zeros(n, dtype=np.int32), agenda.ravel(), 0
    while True:
        best = agenda.min(axis=0)
        live = np.flatnonzero(best < none)
        if not len(live):
            break
        best = best[live]
        taken[live] += 1
        a = best & (1 << int(place_bits)) - 1
        cell = a * n + live
        flat[cell] = none
        skipped = (paths[live] == step).any(axis=1)
        step += 1
        kept = ~skipped
        live, a, cell, rank = live[kept], a[kept], cell[kept], (best[kept] >> place_bits).astype(np.int32)
        if not len(live):
            continue
        middle = flat_nxt[cell].astype(np.int64) * n + live
        end = flat_nxt[middle]
        flat_sym[cell], flat_nxt[cell] = rank, end
        flat[middle], starts[middle] = none, False
        more = np.flatnonzero(end < size[live])
        if len(more):
            after = end[more].astype(np.int64) * n + live[more]
            flat_prv[after] = a[more]
            found = merges.ranks(rank[more], flat_sym[after]).astype(np.int64)
            flat[cell[more]] = np.where(found < _NONE, found << place_bits | a[more], none)
        before = flat_prv[cell]
        more = np.flatnonzero(before >= 0)
        if len(more):
            left = before[more].astype(np.int64)
            there = left * n + live[more]
            found = merges.ranks(flat_sym[there], rank[more]).astype(np.int64)
            flat[there] = np.where(found < _NONE, found << place_bits | left, none)
    who, where = np.nonzero(starts.reshape(width, n).T)
    final = sym.T[who, where]
    lost = np.flatnonzero(final == merges.unknown)
    if len(lost):
        spare = [vocab.fallback(tokens[i][j]) for i, j in zip(who[lost].tolist(), where[lost].tolist(), strict=True)]
        many = np.ones(len(final), dtype=np.int64)
        many[lost] = list(map(len, spare))
        ids = np.repeat(merges.piece_ids[np.minimum(final, merges.unknown - 1)], many)
        begin = np.cumsum(many) - many
        ids[np.concatenate([np.arange(b, b + len(x)) for b, x in zip(begin[lost].tolist(), spare, strict=True)])] = np.concatenate(spare)
        return ids.astype(np.int32), np.bincount(who, weights=many, minlength=n).astype(np.int64), taken
    return merges.piece_ids[final], np.bincount(who, minlength=n).astype(np.int64), taken


class Memory:
    """Segmentations that a worker has met: a tree for each pre-token. Its root is the cut without skips; a child is the cut with one more skip, by its place.

    Nodes are entries of arrays, so that all occurrences of a block walk their trees together. Memory is bounded in bytes:
    a memory beyond `limit` starts anew before the next block. What is remembered never changes a result.
    """

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.vocab = limit, None
        self.forget()

    def block(self, vocab: Pieces) -> None:
        """Makes ready for a block of texts."""
        if vocab is not self.vocab or self.size() > self.limit:
            self.vocab, self.merges = vocab, _merges(vocab)
            self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.chars = 0
        self.ids, self.n_ids = np.zeros(1 << 12, dtype=np.int32), 0
        self.children, self.n_children = np.zeros(1 << 12, dtype=np.int32), 0
        self.begin, self.count, self.taken, self.base = (np.zeros(1 << 10, dtype=np.int64) for _ in range(4))
        self.nodes = 0

    def size(self) -> int:
        """Bytes held, about: a pre-token's text and dictionary entry take some 150 more than its characters."""
        return 4 * self.n_ids + 4 * self.n_children + 32 * self.nodes + 150 * len(self.roots) + 4 * self.chars

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 3 * len(a) // 2), dtype=a.dtype)
        out[: len(a)] = a
        return out

    def add(self, tokens: list[str], paths: np.ndarray) -> np.ndarray:
        """New nodes for the cuts of tokens with the skips of paths."""
        out = np.arange(self.nodes, self.nodes + len(tokens))
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        order = np.argsort(sizes, kind="stable")
        top = self.nodes + len(tokens)
        self.begin, self.count, self.taken, self.base = (self._room(a, top) for a in (self.begin, self.count, self.taken, self.base))
        for at in range(0, len(order), LOCKSTEP):
            rows = order[at : at + LOCKSTEP]
            ids, count, taken = cut_all([tokens[i] for i in rows.tolist()], paths[rows], self.vocab, self.merges)
            nodes = out[rows]
            self.ids = self._room(self.ids, self.n_ids + len(ids))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.begin[nodes], self.count[nodes] = self.n_ids + np.cumsum(count) - count, count
            self.n_ids += len(ids)
            self.taken[nodes], self.base[nodes] = taken, self.n_children + np.cumsum(taken) - taken
            grown = self.n_children + int(taken.sum())
            self.children = self._room(self.children, grown)
            self.children[self.n_children : grown] = -1
            self.n_children = grown
        self.nodes = top
        return out

    def rooted(self, tokens: list[str]) -> np.ndarray:
        """The root of each token; new ones are cut together."""
        get = self.roots.get
        out = np.fromiter([get(t, -1) for t in tokens], dtype=np.int64, count=len(tokens))
        lost = np.flatnonzero(out < 0)
        if len(lost):
            missing = [tokens[i] for i in lost.tolist()]
            fresh_ones = list(dict.fromkeys(missing))
            nodes = self.add(fresh_ones, np.full((len(fresh_ones), 1), -1, dtype=np.int64))
            self.roots.update(zip(fresh_ones, nodes.tolist(), strict=True))
            self.chars += sum(map(len, fresh_ones))
            out[lost] = [self.roots[t] for t in missing]
        return out

    def cut(self, tokens: list[str], x: np.ndarray, scale: float) -> np.ndarray:
        """The node of each occurrence; x holds the hash that its skips are drawn from."""
        node = self.rooted(tokens)
        if not scale:
            return node
        open_ = np.arange(len(tokens))
        path = _gaps(x, scale)[:, None]
        while True:
            going = np.flatnonzero(path[:, -1] < self.taken[node[open_]])
            if not len(going):
                return node
            open_, path, x = open_[going], path[going], x[going]
            slot = self.base[node[open_]] + path[:, -1]
            child = self.children[slot].astype(np.int64)
            lost = np.flatnonzero(child < 0)
            if len(lost):
                slots, one, which = np.unique(slot[lost], return_index=True, return_inverse=True)
                one = lost[one]
                nodes = self.add([tokens[i] for i in open_[one].tolist()], path[one])
                self.children[slots] = nodes
                child[lost] = nodes[which]
            node[open_] = child
            x = _mixed_all(x + np.uint64(_STEP))
            path = np.c_[path, path[:, -1] + 1 + _gaps(x, scale)]


@lru_cache(maxsize=2)
def _merges(vocab: Pieces) -> Merges:
    return Merges(vocab)


@lru_cache(maxsize=2)
def _remembered(model: bytes) -> Memory:
    return Memory()


def encode_texts(texts: list[str], vocab: Pieces, known: Memory, docs: list[int], dropout: float, turns: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids one behind the other, how many each text has) of whole texts; a turn is the pass that reads a text."""
    known.block(vocab)
    split = list(map(pre_tokens, texts))
    tokens = list(chain.from_iterable(split))
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    if not tokens:
        return np.zeros(0, dtype=np.int32), sizes
    x, scale = np.zeros(0, dtype=np.uint64), 0.0
    if dropout:
        scale = _scale(dropout)
        base = np.array([xxhash.xxh64_intdigest(f"{seed} {d} {t}") for d, t in zip(docs, turns, strict=True)], dtype=np.uint64)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x = _mixed_all(place.astype(np.uint64) * np.uint64(_STEP) + np.repeat(base, sizes))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    long = np.flatnonzero(lengths > LONGEST)
    apart: dict[int, np.ndarray] = {}
    for i in long.tolist():
        # a long pre-token seldom comes again with the same skips: it is cut by itself, its characters stay out of the arrays
        skips = iter((_NEVER,))
        if dropout:
            first = int(_gaps(x[i : i + 1], scale)[0])
            skips = chain((first,), _skips(int(x[i]), first, scale))
        apart[i] = np.array(cut(tokens[i], vocab, skips)[0], dtype=np.int32)
    short = np.flatnonzero(lengths <= LONGEST)
    at = np.zeros(len(tokens), dtype=np.int64)
    if len(short):
        at[short] = known.cut([tokens[i] for i in short.tolist()] if len(long) else tokens, x[short] if dropout else x, scale)
    count = known.count[at] if known.nodes else np.zeros(len(tokens), dtype=np.int64)
    if len(long):
        count[long] = [len(apart[i]) for i in long.tolist()]
    ends = np.cumsum(count)
    source = np.repeat((known.begin[at] if known.nodes else 0) - (ends - count), count) + np.arange(ends[-1])
    if len(long):
        held = np.repeat(lengths > LONGEST, count)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        out[~held] = known.ids[source[~held]]
        out[held] = np.concatenate([apart[i] for i in long.tolist()])
    else:
        out = known.ids[source]
    edges = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
    return out, np.diff(edges)


def encode_text(text: str, vocab: Pieces, known: Memory, doc: int, dropout: float, turn: int, seed: int) -> np.ndarray:
    """The ids of one whole text."""
    return encode_texts([text], vocab, known, [doc], dropout, [turn], seed)[0]


def decode_ids(ids: list[int], vocab: Pieces) -> str:
    """The text whose ids these are."""
    if not ids:
        return ""
    raw = vocab.raw
    return b"".join([raw[i] for i in ids])[1:].decode()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, dropout: float = DROPOUT, pass_col: str | None = None, seed: int = SEED, keep_pass: bool = False) -> DataFrame:
    """(id_col, ids, n_tokens, lossless) for every row: ids of the whole text, and whether decoding them returned it.

    Null texts have null ids, empty texts empty ones; both are lossless. Rows with equal ids, texts and values of pass_col, a
    whole number, get equal ids; a text without an id draws by its own hash. keep_pass adds pass_col. An empty table gives an empty
    table. Texts may be of any length: a longer one than BLOCK_BYTES is cut by itself. A result's name that id_col has gets
    underscores added.
    """
    model = load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = pieces(model), _remembered(model)
        for b in batches:
            for part in blocks(b, 2, BLOCK_BYTES):
                docs_, texts, turns = (part.column(k).to_pylist() for k in (1, 2, 3))
                ids, sizes = encode_texts([t or "" for t in texts], vocab, known, docs_, dropout, turns, seed)
                offsets = np.r_[0, np.cumsum(sizes)]
                same = [t is None or decode_ids(ids[a:b].tolist(), vocab) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                mask = part.column(2).is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids), mask=pa.array(mask))
                out = [part.column(0), lists, pa.array(sizes, mask=mask), pa.array(same), *([part.column(3)] if keep_pass else [])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(fresh([id_col], c) for c in ("ids", "n_tokens", "lossless")), *([fresh([id_col], pass_col)] if keep_pass else [])]
    number = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    turn = F.coalesce(F.col(pass_col).cast("long"), F.lit(0).cast("long")) if pass_col else F.lit(0).cast("long")
    rows = docs.select(id_col, *[c.alias(fresh([id_col], name)) for c, name in ((number, "_doc"), (F.col(text_col), "_text"), (turn, "_turn"))])
    kinds = [kind, "array<int>", "long", "boolean", "long"]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=False)))


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded with the text of ids_col as out_col (null for null); a column of that name is replaced."""
    model = load(model_path)

    def run(ids):
        vocab = pieces(model)
        return ids.map(lambda x: None if x is None else decode_ids(list(x), vocab))

    import pandas as pd

    run.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return encoded.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
