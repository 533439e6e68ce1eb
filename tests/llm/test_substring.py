"""Repeated passages: ids that repeat, heavy ids, boilerplate, hashes that lie."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window):
    """(id, words left) of each row, sorted; a window goes if its words start at a smaller id, or at the same id and a smaller start."""
    first = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone[s : s + window] = [True] * window
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    return sorted((r["doc_id"], " ".join(r["text"].split())) for r in substring.remove_repeats(docs, **options).collect())


def test_ids_that_repeat(spark):
    w, x = (" ".join(f"{c}{i}" for i in range(25)) for c in "wx")
    rows = [(1, w), (2, x), (2, w), (3, x)]
    assert got(spark, rows) == brute(rows, 20) == [(1, w), (2, ""), (2, x), (3, "")]
    rows = [(2, w), (2, w), (2, x + " " + w), (5, w)]
    assert got(spark, rows) == brute(rows, 20)


@pytest.mark.parametrize("shard_bytes", [6_000_000, 500])
def test_random_texts_with_heavy_ids(spark, shard_bytes):
    rng = random.Random(2)
    parts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(4, 30))) for _ in range(12)]
    rows = [(rng.choice([7, 7, 7, *range(30)]), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for _ in range(120)]
    assert got(spark, rows, window=6, phrase=3, shard_bytes=shard_bytes) == brute(rows, 6)


def test_boilerplate_in_every_document(spark):
    line = " ".join(f"licence{i}" for i in range(40))
    rows = [(i, f"own{i} text {line} end{i}") for i in range(300)]
    assert got(spark, rows, shard_bytes=2_000) == brute(rows, 20)


def test_the_automaton_decides_not_the_hash(spark, monkeypatch):
    """With all phrase hashes of a document alike, only bytes tell which phrases occur."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(4)] + [(9, " ".join(f"w1x{j}" for j in range(30)))]
    confirmed = {"t": [b"w1x0 w1x1 w1x2 w1x3 w1x4"]}
    run = substring._candidates(20, 5)

    monkeypatch.setattr(substring, "_phrase_hashes", lambda h, phrase: np.zeros(len(h) - phrase + 1, dtype=np.uint64))
    docs = pa.table({"shard": pa.array([0] * 5, pa.int32()), "t": [t.encode() for _, t in rows], "key": [i for i, _ in rows], "text_hash": list(range(5))})
    found = run(docs, pa.table({"shard": [0], "t": pa.array(confirmed["t"], pa.binary())}))
    spans = {k: np.frombuffer(s, "<i4").tolist() for k, s in zip(found.column("key").to_pylist(), found.column("spans").to_pylist()) if s is not None}
    assert spans == {1: [0, 1], 9: [0, 1]}


def test_named_phrases_of_equal_windows_are_equal():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 63, size=500, dtype=np.uint64)
    g[200:260] = g[20:80]
    for span in (1, 2, 3, 4, 7, 16):
        at = substring.named(g, span)
        assert all(i <= a < i + span for i, a in enumerate(at))
        assert (at[200 : 260 - span + 1] - 180 == at[20 : 80 - span + 1]).all()


def test_long_texts(spark):
    long = " ".join(f"a{i % 50_000}" for i in range(120_000))
    rows = [(1, long), (2, "x" * 1_000_000), (3, "x" * 1_000_000 + " " + " ".join(long.split()[:300]))]
    assert [len(t.split()) for _, t in got(spark, rows)] == [50_000, 1, 1]



@pytest.mark.parametrize("hash_bits", [1, 3])
def test_unlike_phrases_of_one_hash_are_all_looked_for(spark, hash_bits):
    """Two or eight hashes name all phrases, so nearly all collide; the windows that repeat still go, and only they."""
    rng = random.Random(9)
    parts = [" ".join(f"p{k}x{i}" for i in range(26)) for k in range(6)]
    rows = [(i, " ".join([f"own{i}", *rng.sample(parts, 2), f"end{i}"])) for i in range(30)]
    batch = pa.record_batch([pa.array([0] * len(rows), pa.int32()), pa.array([t.encode() for _, t in rows])], names=["shard", "t"])
    named = [(h, t) for out in substring._named_phrases(20, 5, hash_bits)([batch]) for h, t in zip(out.column(0).to_pylist(), out.column(3).to_pylist())]
    assert len({h for h, _ in named}) <= 1 << hash_bits < len({t for _, t in named}) == len(named)
    assert got(spark, rows, hash_bits=hash_bits) == brute(rows, 20)


def test_windows_of_one_shard_stay_there():
    """Only windows whose phrase other shards name too leave their shard; repeats inside the shard are settled in it."""
    own, both = (" ".join(f"{c}{j}" for j in range(24)) for c in "pq")
    docs = pa.table({"shard": pa.array([0] * 4, pa.int32()), "t": [own.encode(), own.encode(), both.encode(), both.encode()], "key": [1, 2, 3, 4], "text_hash": list(range(4))})
    phrases = [" ".join(t.split()[i : i + 5]) for t in (own, both) for i in range(20)]
    sent = pa.table({"shard": [0] * 40, "t": pa.array([p.encode() for p in phrases], pa.binary()), "wide": [False] * 20 + [True] * 20})
    found = substring._candidates(20, 5)(docs, sent).to_pylist()
    assert sorted((r["key"], r["start"]) for r in found if r["spans"] is None) == [(3, i) for i in range(5)]
    assert {r["key"]: np.frombuffer(r["again"], "<i4").tolist() for r in found if r["spans"] is not None} == {1: [], 2: [0, 5], 3: [], 4: [0, 5]}


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6, 7, 20])
def test_rolled_hashes(width):
    h = np.random.default_rng(width).integers(0, 1 << 64, 60, dtype=np.uint64)
    plain = [sum(int(h[i + k]) * pow(substring._P1, k, 1 << 64) for k in range(width)) % (1 << 64) for i in range(len(h) - width + 1)]
    assert substring._rolled(h, width, substring._P1).tolist() == plain
