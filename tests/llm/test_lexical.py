"""Lexical search against plain sums, the cuts against all cuts, skipping, ties, edges."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from brindle.llm import lexical


def brute(docs, queries, k=10):
    """(item, rank, id, score) of rows (id, text) and (item, text)."""
    split = [(i, lexical.terms((t or "").encode())) for i, t in docs]
    n, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in dict.fromkeys(queries):
        scored = []
        for i, w in split:
            tf, s = Counter(w), 0
            for t in set(lexical.terms((text or "").encode())):
                if tf[t]:
                    m = 10 + 90 * len(w) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, queries, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, q, **options).collect()), key=str)


def test_terms():
    assert lexical.terms("Ab-c9 É_ñ x\x7fY🙂 İ".encode()) == [x.encode() for x in ("ab", "c9", "É", "ñ x", "y🙂", "İ")]
    assert lexical.terms(None) == lexical.terms(b"") == []


@pytest.mark.parametrize("seed", range(8))
def test_cuts_have_the_least_cost(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 9, 6)
    scores = rng.integers(1, 30, int(lengths.sum()))
    charge = rng.integers(0, 25, 6)
    ends, top = lexical.block_ends(scores, lengths, charge, longest=4)
    begin = np.cumsum(lengths) - lengths
    for b, n, c in zip(begin.tolist(), lengths.tolist(), charge.tolist()):

        def cost(cuts):
            edges = [b, *cuts, b + n]
            if max(np.diff(edges)) > 4:
                return math.inf
            return sum(len(scores[x:y]) * scores[x:y].max() - scores[x:y].sum() + c for x, y in zip(edges, edges[1:]))

        own = [e for e in ends.tolist() if b < e < b + n]
        assert b + n in ends
        assert cost(own) == min(cost([b + i for i, cut in enumerate(bits, 1) if cut]) for bits in product((0, 1), repeat=n - 1))
    assert top.tolist() == [scores[x:y].max() for x, y in zip([0, *ends[:-1]], ends)]


def make_shard(rng, n_docs, n_terms):
    lists = [np.flatnonzero(rng.random(n_docs) < p) for p in rng.choice([0.002, 0.05, 0.4], n_terms)]
    lists = [x if len(x) else np.array([0]) for x in lists]
    counts = np.array([len(x) for x in lists])
    scores = np.concatenate([rng.integers(1, 50, len(x)) ** 2 for x in lists])
    pieces, owner = lexical._chunks(counts)
    ends, top = lexical.block_ends(scores, pieces, np.full(len(pieces), 500))
    docs, begin = np.concatenate(lists), np.r_[0, np.cumsum(counts)]
    return lexical.Shard(np.arange(n_terms) * 2, begin, docs, scores, np.r_[0, np.searchsorted(ends, begin[1:], "right")], docs[np.r_[0, ends[:-1]]], docs[ends - 1], top)


@pytest.mark.parametrize("seed", range(6))
def test_shard_against_full_sums(seed):
    rng = np.random.default_rng(seed)
    shard = make_shard(rng, 9000, 12)
    full = np.zeros(9000, dtype=np.int64)
    query = np.array([0, 2, 3, 6, 8, 10, 14, 99])
    for i in (0, 1, 3, 4, 5, 7):
        full[shard.docs[shard.begin[i] : shard.begin[i + 1]]] += shard.scores[shard.begin[i] : shard.begin[i + 1]]
    want = np.lexsort((np.arange(9000), -full))[:10]
    (d, s), looked = lexical.search_shard(shard, query, 10)
    assert d.tolist() == want.tolist() and s.tolist() == full[want].tolist()
    (d, s), fewer = lexical.search_shard(shard, query, 10, least=int(full[want[-1]]))
    assert d.tolist() == want.tolist() and fewer <= looked
    (d, s), few = lexical.search_shard(shard, query, 10, seeds=4)
    assert (full[d] == s).all() and few < 9000 / 4


def test_blocks_are_skipped():
    """A rare term decides: the intervals far from it are not summed."""
    rng = np.random.default_rng(1)
    n = 20_000
    common, rare = np.arange(n), np.sort(rng.choice(n, 12, replace=False))
    scores = np.r_[rng.integers(1, 10, n), np.full(12, 1000)]
    counts = np.array([n, 12])
    pieces, _ = lexical._chunks(counts)
    ends, top = lexical.block_ends(scores, pieces, np.full(len(pieces), 100))
    docs, begin = np.r_[common, rare], np.r_[0, n, n + 12]
    shard = lexical.Shard(np.array([0, 1]), begin, docs, scores, np.r_[0, np.searchsorted(ends, begin[1:], "right")], docs[np.r_[0, ends[:-1]]], docs[ends - 1], top)
    (d, _), looked = lexical.search_shard(shard, np.array([0, 1]), 10, least=1000)
    assert set(d) <= set(rare) and looked == 12


@pytest.mark.parametrize("small", [False, True])
def test_search_against_plain_sums(spark, monkeypatch, small):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i if i % 37 else None, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(7, "t1 t2"), (7, "t1 t2"), (8, "t1 t2"), (9, None), (10, "--- \t"), (11, "É " * 5000)] + [(900 + i, "T3, t4. t5") for i in range(30)]
    queries = [(1, "t1 T2 t39 t39"), (2, "t3 t4 t5"), (3, "nothing"), (4, None), (5, "É"), (6, " ".join(vocabulary)), (6, "t7"), (1, "t1 T2 t39 t39"), (None, "x9")]
    if small:
        monkeypatch.setattr(lexical, "QUERY_ROWS", 3)
        monkeypatch.setattr(lexical, "CHUNK", 8)
    assert got(spark, docs, queries) == brute(docs, queries)


def test_empty_tables_and_clashing_names(spark):
    docs, queries = spark.createDataFrame([(1, "a")], "rank long, text string"), spark.createDataFrame([("q", "A")], "score string, text string")
    found = lexical.search(docs, queries, id_col="rank", query_id="score")
    assert found.columns == ["score_", "rank", "rank_", "score"] and [tuple(r)[:3] for r in found.collect()] == [("q", 1, 1)]
    assert lexical.search(docs.limit(0), queries, id_col="rank", query_id="score").count() == 0
    assert lexical.search(docs, queries.limit(0), id_col="rank", query_id="score").count() == 0


def test_query_matches_sql(spark, sf_dir, duck):
    found = lexical.op11_lexical_search(spark, sf_dir).toPandas()
    want = duck.sql(lexical.ORACLE_SQL).df()
    key = ["item_id", "rank"]
    assert found[[*key, "doc_id", "score"]].sort_values(key).values.tolist() == want[[*key, "doc_id", "score"]].sort_values(key).values.tolist()
