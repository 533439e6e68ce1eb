"""Merge-dropout is drawn by every occurrence of a pre-token."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import pieces, sentencepieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocab():
    return pieces.pieces(pieces.load(pieces.DEFAULT_MODEL))


def test_a_word_of_one_merge_is_split_in_a_tenth_of_its_occurrences(vocab):
    known, word = sentencepieces.Memory(), next(p for p in vocab.ids if len(p) == 2 and p[0] == pieces.MARK and p[1].isalpha())
    n = 4000
    for doc in (1, 2, 3):
        ids = sentencepieces.encode_text(" ".join([word[1]] * n), vocab, known, doc, 0.1, 0, 0)
        assert 0.08 < (len(ids) - n) / n < 0.12


def test_cuts_are_distributed_as_by_one_draw_a_candidate(vocab):
    rng = np.random.default_rng(1)
    word, n = "segmentation", 20_000
    got = Counter()
    known = sentencepieces.Memory(limit=50)  # smaller than the number of cuts
    for doc in range(20):
        ids = sentencepieces.encode_text(" ".join([word] * (n // 20)), vocab, known, doc, 0.2, 0, 3).tolist()
        text, starts = "", []
        for i in ids:
            raw = vocab.raw[i].decode()
            starts.append(raw)
            text += raw
        now = ()
        for raw in starts:
            now += (raw,)
            if "".join(now) == " " + word:
                got[now] += 1
                now = ()
    want = Counter()
    for _ in range(n):
        skips = iter(np.flatnonzero(rng.random(200) < 0.2).tolist() + [1 << 30])
        want[tuple(vocab.raw[i].decode() for i in sentencepieces.cut(pieces.MARK + word, vocab, skips)[0])] += 1
    assert sum(got.values()) == n and len(got) > 20
    assert all(abs(got[c] - want[c]) < 6 * (want[c] + got[c] + 10) ** 0.5 for c in want | got)


def test_passes_of_a_document_differ(spark):
    text = "the quick brown segmentation jumps over lazy tokens " * 20
    docs = spark.createDataFrame([(1, text, "en", "a", 1)] * 3 + [(2, text, "en", "a", 1)], DOCS)
    rows = corpus_pipeline.sentencepiece(spark, docs, "").collect()
    assert len({tuple(r["ids"]) for r in rows}) == 4 and all(r["lossless"] for r in rows)
    again = corpus_pipeline.sentencepiece(spark, docs, "").collect()
    assert sorted(tuple(r["ids"]) for r in rows) == sorted(tuple(r["ids"]) for r in again)


def brute(token, vocab, skipped):
    """The cut by the definition: the best candidate, then the leftmost, is skipped or merged, until none is left."""
    symbols, done, place = list(token), set(), 0
    while True:
        spots = np.cumsum([0, *map(len, symbols)])
        open_ = [(vocab.ranks[a + b], spots[i], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in vocab.ranks and (spots[i], spots[i + 2]) not in done]
        if not open_:
            return [x for s in symbols for x in ([vocab.ids[s]] if s in vocab.ids else vocab.fallback(s))]
        _, start, i = min(open_)
        if place in skipped:
            done.add((start, spots[i + 2]))
        else:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        place += 1


def test_every_occurrence_is_cut_by_its_own_agenda(vocab):
    rng = np.random.default_rng(4)
    words = "segmentation of the lazily tokenised tokenised banana mississippi aaaaaaaa a".split() + ["naïve", "日本語", "x\x00y", "▁", "\n\n", "z" * 60, "ab" * 40]
    for limit in (1, 1 << 20):
        known = sentencepieces.Memory(limit)
        for doc in range(30):
            text = " ".join(rng.choice(words, size=40))
            tokens, want = pieces.pre_tokens(text), []
            x = sentencepieces._mixed_all(np.arange(len(tokens), dtype=np.uint64) * np.uint64(sentencepieces._STEP) + np.uint64(sentencepieces.xxhash.xxh64_intdigest(f"9 {doc} 2")))
            for token, own in zip(tokens, x):
                first = int(sentencepieces._gaps(np.array([own]), sentencepieces._scale(0.3))[0])
                more = sentencepieces._skips(int(own), first, sentencepieces._scale(0.3))
                want += brute(token, vocab, {first, *(next(more) for _ in range(200))})
            assert sentencepieces.encode_text(text, vocab, known, doc, 0.3, 2, 9).tolist() == want


def test_memory_is_bounded_in_bytes(vocab):
    known = sentencepieces.Memory(limit=200_000)
    for doc in range(20):
        sentencepieces.encode_text(" ".join(f"w{doc}x{i}" for i in range(500)), vocab, known, doc, 0.1, 0, 1)
        known.block(vocab)
        assert known.size() <= 200_000


def test_very_long_texts_and_tokens(spark, vocab):
    docs = spark.createDataFrame([(1, "word " * 200_000, None, None, 1), (2, "y" * 200_000, None, None, 1), (None, None, None, None, None), (None, "", None, None, 0)], DOCS)
    rows = {(r["doc_id"], r["n_tokens"]): r for r in sentencepieces.encode(docs).collect()}
    assert all(r["lossless"] for r in rows.values()) and {k[1] for k in rows if k[0] is None} == {None, 0}
    assert sentencepieces.encode(docs.where("false")).count() == 0
