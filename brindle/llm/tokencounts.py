"""Token counts under a unigram model, by trie-shared dynamic programming.

The best segmentation of a pre-token is found left to right: best[i] is the highest score of a segmentation of its first i
characters. best[i] depends on these characters alone, so pre-tokens that share a prefix share its scores. A worker sorts
the distinct pre-tokens of a block of texts, which walks their trie depth first: it keeps the scores along the current path,
goes back to the common prefix with the next pre-token and computes the rest. The token count at a pre-token's terminal is
stored; a text's count is the sum over its pre-tokens. No shuffle, and memory is bounded by the block.

The pieces are those of a public vocabulary without unigram scores; a piece of merge rank r scores -log(r + RANK_OFFSET),
the usual law of frequency by rank. Ties go to fewer tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh, read
from brindle.llm.pieces import DEFAULT_MODEL, LITERAL, Pieces, load, pieces, pre_tokens

RANK_OFFSET = 10.0
#: The score of one byte of a character that has no piece.
BYTE_SCORE = -14.0
#: Bytes of text whose pre-tokens share one trie.
BLOCK_BYTES = 24_000_000
#: Terminal counts a worker keeps from earlier tries, of pre-tokens of at most LONGEST characters; it starts anew when it has more.
KEPT_TERMINALS = 600_000
LONGEST = 48


def unigram_scores(vocab: Pieces) -> dict[str, float]:
    """piece -> log score; a piece's rank is minus its score in the file."""
    return {p: -math.log(max(0.0, -vocab.scores[i]) + RANK_OFFSET) for p, i in vocab.ids.items() if p != LITERAL}


def trie_counts(tokens: list[str], scores: dict[str, float], longest: int) -> dict[str, int]:
    """The number of tokens in the best segmentation of each of the distinct tokens."""
    out: dict[str, int] = {}
    best, count = [0.0], [0]  # along the path to the current trie node
    last = ""
    get = scores.get
    for token in sorted(tokens):
        common, most = 0, min(len(last), len(token))
        while common < most and last[common] == token[common]:
            common += 1
        del best[common + 1 :], count[common + 1 :]
        for i in range(common + 1, len(token) + 1):
            j = i - 1
            got = get(token[j:i])
            if got is None:
                more = 3 if token[j] == LITERAL else len(token[j].encode())
                top, n = best[j] + BYTE_SCORE * more, count[j] + more
            else:
                top, n = best[j] + got, count[j] + 1
            for j in range(i - 2, i - longest - 1 if i > longest else -1, -1):
                got = get(token[j:i])
                if got is not None:
                    got += best[j]
                    if got > top or (got == top and count[j] < n - 1):
                        top, n = got, count[j] + 1
            best.append(top)
            count.append(n)
        out[token] = count[-1]
        last = token
    return out


@lru_cache(maxsize=1)
def _terminals(model: bytes) -> dict[str, int]:
    return {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, n_pre_tokens, n_tokens) for every row. Null and empty texts have 0 of both.

    Repeated rows are counted one by one; an empty table gives an empty table; whole texts are read, a longer one than a block by
    itself. A result's name that id_col has gets underscores added.
    """
    model = load(model_path)
    names = [id_col, *(fresh([id_col], c) for c in ("n_pre_tokens", "n_tokens"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model)
        scores = unigram_scores(vocab)
        for b in batches:
            sizes, at = b.column(1).cast(pa.binary()), 0
            while at < b.num_rows:
                end, chars = at, 0
                while end < b.num_rows and (end == at or chars < BLOCK_BYTES):
                    chars += len(sizes[end].as_py() or b"")
                    end += 1
                part = b.slice(at, end - at)
                at = end
                split = [Counter(pre_tokens(t or "")) for t in part.column(1).to_pylist()]
                known = _terminals(model)
                if len(known) > KEPT_TERMINALS:
                    known.clear()
                found = trie_counts([t for t in set().union(*split) if t not in known], scores, vocab.longest)
                known.update(found)
                n_tokens = [sum(known[t] * n for t, n in c.items()) for c in split]
                for t in found:
                    if len(t) > LONGEST:
                        del known[t]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.total() for c in split], type=pa.int64()), pa.array(n_tokens, type=pa.int64())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias(fresh([id_col], "_text"))).mapInArrow(run, f"`{id_col}` {kind}, `{names[1]}` long, `{names[2]}` long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
