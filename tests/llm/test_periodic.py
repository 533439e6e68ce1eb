"""Periodic runs against a search of every period, the tree's parts against plain versions, edges, the query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from brindle.llm import periodic


def brute(w):
    """(start, length, period) of the runs of a list of words, by trying every period everywhere."""
    spans = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                spans.setdefault((i, length), q)  # the least period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in spans.items())


def left(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        w = []
        while len(w) < rng.randint(0, 90):
            part = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))]
            w += part * rng.choice([1, 1, 2, 3, 4, 5, 9]) + part[: rng.randint(0, len(part))]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_blocks_against_every_period(seed):
    given = texts(seed)
    split, runs = periodic.block_runs([" ".join(w).encode() for w in given])
    assert [[x.decode() for x in w] for w in split] == given
    assert runs == [brute(w) for w in given]
    assert [periodic.collapsed(w, r).decode() for w, r in zip(split, runs, strict=True)] == [left(w, r) for w, r in zip(given, runs, strict=True)]


def test_the_tree(seed=3):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2, 200)
    order, levels = periodic.suffix_array(codes)
    c = codes.tolist()
    assert order.tolist() == sorted(range(len(c)), key=lambda i: c[i:])
    lcp = periodic.common_prefixes(order, levels)

    def shared(i, j):
        k = 0
        while max(i, j) + k < len(c) and c[i + k] == c[j + k]:
            k += 1
        return k

    assert lcp[1:].tolist() == [shared(i, j) for i, j in zip(order[:-1], order[1:], strict=True)]
    start, period = periodic.branching_repeats(codes)
    want = {(i, p) for i in range(len(c)) for p in range(1, (len(c) - i) // 2 + 1) if c[i : i + p] == c[i + p : i + 2 * p] and (i + 2 * p == len(c) or c[i + p] != c[i + 2 * p])}
    assert set(zip(start.tolist(), period.tolist(), strict=True)) == want


def test_smaller_half_lists_stay_small():
    codes = np.zeros(20_000, dtype=np.int64)
    order, levels = periodic.suffix_array(codes)
    _, first, last, a, b = periodic.nodes(periodic.common_prefixes(order, levels)).T
    assert (last - first + 1 - (b - a + 1)).sum() <= len(codes) * 15
    assert periodic.maximal_runs(codes) == [(0, 20_000, 1)]


def test_stretches_hold_all_runs_and_prose_has_none():
    w = [f"w{i % 1000}" for i in range(2500)]
    _, runs = periodic.block_runs([" ".join(w).encode(), b"a a a a a", b"a a a a a a", b"a b a b a b a b", None, b""])
    assert runs == [[], [], [(0, 6, 1)], [(0, 8, 2)], [], []]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_query_against_every_period(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 9000).collect()}
    hits = 0
    for r in periodic.op12_periodic_runs(spark, sf_dir).collect():
        if r["doc_id"] not in docs:
            continue
        w = planted(r["doc_id"], [x.decode() for x in docs[r["doc_id"]]])
        runs = brute(w)
        hits += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3) and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left(w, runs).encode()).hexdigest()
    assert hits > 10


def test_table_edges(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "a b " * 5, "z"), (2, "a b " * 5, "z"), (3, "é " * 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(periodic.periodic_runs(docs, ["doc_id", "runs"]).collect(), key=str)
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"]) for r in got) == [("1", 0, 0, ""), ("2", 10, 1, "a b"), ("2", 10, 1, "a b"), ("3", 6, 1, "é"), ("None", 0, 0, "")]
    assert periodic.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
    tail = docs.select(periodic.with_periodic_tail(F_col("doc_id"), F_col("text")).alias("t")).collect()
    assert len(tail) == 5


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
