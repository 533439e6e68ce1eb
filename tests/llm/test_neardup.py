"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from brindle.llm import common, neardup, simhash
from brindle.operators.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_parts(texts):
    part = list(range(len(texts)))
    sets = [grams(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and part[i] != part[j]:
            low, high = sorted((part[i], part[j]))
            part = [low if p == high else p for p in part]
    return part


def similar(a, b):
    both = len(set(a.tolist()) & set(b.tolist()))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def test_stage_reaches_a_similarity_of_08(spark):
    rng = random.Random(7)
    rows = [prose(rng, 120) for _ in range(20)]
    for base in list(rows):  # two or four words changed: similarity of 0.84 and 0.71
        for n in (2, 4):
            changed = list(base)
            for at in rng.sample(range(10, 110, 10), n):
                changed[at] = "other"
            rows.append(changed)
    base = prose(rng, 400)  # a group larger than a small bucket
    rows += [[*base[:at], "other", *base[at + 1 :]] for at in range(5, 395, 10)]
    texts = [" ".join(r) for r in rows]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    part = brute_parts(texts)
    found = connected_components(neardup.links(docs), common.settle)
    assert found.select("component").distinct().count() == 21
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(part))


def test_one_row_stays_of_each_group(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(prose(rng, 80)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a + " end"), (None, c), (None, c), (None, b), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", n) for n, (i, t) in enumerate(rows)], DOCS)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted([("1", a), ("2", b), ("None", c), ("3", "None")])


def test_the_bitmaps_rule_out_no_similar_pair(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a = np.unique(rng.integers(0, 1 << 63, size=rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.r_[a[: int(len(a) * rng.uniform(0.6, 1))], rng.integers(0, 1 << 63, size=rng.integers(0, 1 + len(a) // 5), dtype=np.uint64)])
        b = b if len(b) else a
        rows.append((k, len(a), len(b), neardup.bitmap(a).tolist(), neardup.bitmap(b).tolist(), bool(similar(a, b))))
    df = spark.createDataFrame(rows, "k int, n long, m long, a array<long>, b array<long>, similar boolean")
    part = lambda c: [F.get(c, F.lit(i)) for i in range(neardup.MAP_LONGS)]
    got = df.withColumn("may", neardup.may_be_similar(part("a"), part("b"), F.col("n"), F.col("m"), neardup.SIMILARITY)).collect()
    assert all(r["may"] for r in got if r["similar"]) and sum(r["similar"] for r in got) > 50
    assert sum(not r["may"] for r in got) > 20


def star(rng, n, words=120):
    """A text and n copies with two words changed each, ten shingles: similar to the text by 0.84, to each other by about 0.7."""
    base = prose(rng, words)
    out = [base]
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(10, words - 10, 7), 2):
            copy[at] = f"new{k}x{at}"
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("n", [10, 200, 1000])
def test_a_star_of_edited_copies_keeps_one_row(spark, n):
    texts = star(random.Random(n), n)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = [r["doc_id"] for r in neardup.keep_one(docs).collect()]
    # a pair of 0.84 shares no band with a probability of 2 in 100,000
    assert kept == [0]


@pytest.mark.parametrize("block,rounds", [(7, ()), (4096, (2, 9))])
def test_blocks_and_rounds_do_not_change_the_components(spark, block, rounds):
    """A chain of edits: each text is similar to the next only, and all share bands with many."""
    rng = random.Random(11)
    now, texts = prose(rng, 200), []
    for k in range(60):
        now = [*now[:3], *[f"c{k}x{i}" if i // 8 == k % 24 and i % 8 in (0, 5) else w for i, w in enumerate(now) if i >= 3]]
        texts.append(" ".join(now))
    texts += star(rng, 40)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {(r["a"], r["b"]) for r in neardup.links(docs, block=block, rounds=rounds).collect()}
    names = {r["n"]: r["doc_id"] for r in docs.select("doc_id", neardup._node(docs["text"]).alias("n")).collect()}
    part = {i: i for i in range(len(texts))}
    for a, b in found:
        low, high = sorted((part[names[a]], part[names[b]]))
        part = {k: low if p == high else p for k, p in part.items()}
    assert list(part.values()) == brute_parts(texts)


def test_long_texts_and_a_bucket_of_unlike_texts(spark):
    """One shared passage puts unlike texts into common buckets; none is lost, and none is joined."""
    rng = random.Random(12)
    passage = prose(rng, 160)
    texts = [" ".join(passage + prose(rng, 60)) for _ in range(150)]
    long = prose(rng, 60_000)
    texts += [" ".join(long), " ".join([*long[:-1], "end"])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == list(range(151))


@pytest.mark.parametrize("name", ["fp", "component_id", "id", "FP"])
def test_simhash_with_clashing_names(spark, name):
    docs = spark.createDataFrame([(4, "a b c d", 1), (2, "A b c d", 2), (7, "x y", 3), (None, None, 4)], f"`{name}` long, text string, t int")
    out = simhash.near_duplicates(docs, name)
    assert len({c.lower() for c in out.columns}) == 3
    assert sorted((str(r[0]), str(r["component_id"])) for r in out.collect()) == [("2", "2"), ("4", "2"), ("7", "7"), ("None", "None")]
    assert sorted(str(r[name]) for r in simhash.keep_one(docs, name).collect()) == ["2", "7", "None"]


def test_fingerprints_link_what_shingles_do_not(spark):
    # the stage's method is SimHash: a few sentences said again and again weigh more than what comes after them
    from pyspark.sql import functions as F

    from brindle.llm import neardup, simhash

    cycle = " ".join(f"w{i}" for i in range(7)) + " "
    a, b = cycle * 60, cycle * 60 + " ".join(f"x{i}" for i in range(40))
    rows = spark.createDataFrame([(1, a), (2, b), (3, "another text " * 40), (4, None), (5, "")], "doc_id long, text string")
    assert simhash.fingerprint(a.encode()) == simhash.fingerprint(b.encode())
    texts = rows.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    assert simhash.text_links(texts).count() == 1
    assert {r["doc_id"] for r in neardup.keep_one(rows).collect()} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in neardup.keep_one(rows, radius=simhash.RADIUS).collect()} == {1, 3, 4}
