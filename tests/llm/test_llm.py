"""The training-data operators against brute force, exact round trips and held-out labels, on small tables and edge cases."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import sentencepiece
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import ann, chat, common, langid, mixing, pieces, quality, sentencepieces, simhash, substring, tokencounts, toxicity
from brindle.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", n_words long, fp string, size string, kept string, h int, shard int, _key int, id string, score string"


def edge_docs(spark, schema=DOCS, rows=None):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(6000))
    para = " ".join(word() for _ in range(70))
    rows = rows or [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n\x0b\x0c\r ", "en", None, 7), (4, para, "en", "b", None), (5, para, "en", "b", 1), (5, para, "en", "b", 1),
        (6, long, "fr", "c", 1), (7, para.upper() + " end", "en", "b", 1), (None, para, None, None, None), (None, None, None, None, None),
        (8, "x " * 60, "en", "a", 1), (9, "one two", "en", "a", 1), (10, "é 　ß ▁ 日本 😀\u0085x", "en", "zz", 1), (11, long[:9000] + " tail", "fr", "c", 1),
    ]
    width = len(schema.split(","))
    return spark.createDataFrame([r + (None,) * (width - 5) for r in rows], schema)


def empty_docs(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def split(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.sql(ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


# op1


def brute_targets(sizes):
    """Shares by weight; what exceeds a cap is shared again by weight among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check_mix(docs, rows):
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(split(r["text"]))
    want, taken = brute_targets(sizes), {}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        got = sum(p["taken"] for p in r["passes"])
        assert 0 <= got <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + got
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix(docs.collect(), rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    places = sorted(p["position"] for r in rows for p in r["passes"])
    assert places[0] >= 0 and places[-1] <= sum(r["size"] for r in rows)


def test_mixing_caps(spark):
    rows = [(i, "w " * n, "en", s, 1) for i, (s, n) in enumerate([("a", 1), ("b", 400), ("c", 2), ("d", 90), ("e", 0), (None, 5)])]
    docs = edge_docs(spark, rows=rows)
    check_mix(docs.collect(), mixing.mix(docs).collect())




def test_mixing_inverts_demand(spark):
    t = np.linspace(0, 1, 11)
    for tilt in (-0.5, 0.0, 0.4):
        asked = 100 * ((1 - tilt) * t + tilt * t * t)
        df = spark.createDataFrame([(float(x),) for x in asked], "x double")
        got = [r[0] for r in df.select(mixing.when_asked(F.col("x"), F.lit(100.0), F.lit(tilt))).collect()]
        assert np.allclose(got, t)


def test_mixing_edges(spark):
    docs = edge_docs(spark, EXTRA)
    check_mix(docs.collect(), mixing.mix(docs).collect())
    out = mixing.training_order(docs)
    assert out.columns == docs.columns and out.count() >= 1
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.training_order(empty_docs(spark)).count() == 0


# op2


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, data).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    both = got[got["held_out"]].join(labels, how="inner")  # rows that nothing was learned from
    clean, bad = both[both["toxic"] == 0], both[both["toxic"] == 1]
    assert len(bad) > 50 and (clean["predicted"] == 0).mean() >= 0.99 and (bad["predicted"] == 1).mean() >= 0.9
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_toxicity_grammar():
    g = toxicity.Grammar((("moron", 3.0), ("lowei*", 2.0)))
    found = lambda t: [toxicity.clause_counts(c) for c in toxicity.clauses_with_hits(t, g)]
    form = {f: i for i, f in enumerate(toxicity.FORMS)}
    assert found("a kind word. and more") == []
    assert found("what a Moron!")[0][form["I"]] == 3.0
    assert found("you moron")[0][form["It"]] == found("moron, you")[0][form["It"]] == 3.0
    assert found("he is not a moron")[0][form["In"]] == 3.0
    assert found("not at all like a moron")[0][form["I"]] == 3.0
    assert found("she said a moron")[0][form["Ir"]] == 3.0
    assert found("a loweichen. moron, moron") [0][form["I"]] == 2.0 and found("x. moron, moron")[0][form["I"]] == 6.0
    assert found("oxymoron blowei") == []
    assert found("i will kill it")[0][form["Xp"]] == found("i will really kill you")[0][form["Xpt"]] == found("they kill it")[0][form["X"]] == 1.0


def brute_forms(line):
    """The weight of each form of a clause, from the definitions, word by word."""
    out = dict.fromkeys(toxicity.FORMS, 0.0)
    for i, (symbol, weight) in enumerate(line):
        if symbol not in (toxicity.INSULT, toxicity.THREAT):
            continue
        before = [s for s, _ in line[:i]]
        negated = toxicity.NEGATION in before[-toxicity.NEGATION_REACH :]
        purposed = symbol == toxicity.THREAT and toxicity.INTENT in before[-toxicity.INTENT_REACH :]
        targeted = any(s == toxicity.TARGET for s, _ in line)
        kind = "r" if toxicity.REPORT in before else "n" if negated else "p" * purposed + "t" * targeted
        out[symbol + kind] += weight
    return list(out.values())


def test_toxicity_cascade_against_brute_force():
    rng = random.Random(6)
    steps = (toxicity.negation(), toxicity.intent(), toxicity.reported(), toxicity.target())
    for _ in range(3000):
        line = [(rng.choice(["", "", "", *"IXTNRW"]), rng.choice([1.0, 2.5])) for _ in range(rng.randint(1, 14))]
        assert toxicity.clause_counts(line).tolist() == brute_forms(line)
        one_by_one = line
        for step in steps:
            one_by_one = step(one_by_one)
        assert one_by_one == toxicity._FORWARDS(line)


def test_toxicity_edges(spark):
    g = toxicity.Grammar((("x", 1.0),), (0.0,) * toxicity.N_FEATURES, -1.0)
    docs = edge_docs(spark, EXTRA)
    assert toxicity.score(docs, g).count() == docs.count()
    assert toxicity.score(empty_docs(spark), g).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).where("predicted = 0").count() == docs.count()
    one = spark.createDataFrame([(4, 1, 0), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, one).insults == ()


# op3


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, data).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got["held_out"].items())
    assert (held["lang_pred"] == lang[held.index]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_machines():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = langid.svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() >= 0.95
    assert langid.family("pt-BR") == "romance" and langid.family("xx") == "xx"


def test_language_edges(spark):
    docs = edge_docs(spark, EXTRA)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und"
    assert langid.learn(empty_docs(spark)) is None
    assert langid.predict(empty_docs(spark), None).count() == 0
    assert langid.predict(docs, None).where("lang_pred = 'und' AND score = 0").count() == docs.count()


# op4


TURNS = "conv_id long, turn long, role string, text string, chat string, hash string"


def test_chat_collapse(spark):
    def conv(c, *turns):
        return [(c, i, "user" if i % 2 == 0 else "assistant", t, None, None) for i, t in enumerate(turns)]

    rows = conv(1, "a") + conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a", "b", "c") + conv(6, None) + conv(7, "") + conv(8, "a", None)
    rows += [(None, 0, "user", "a", None, None), (9, None, None, None, None, None)]
    got = {r["conv_id"]: r for r in chat.render(chat.maximal(spark.createDataFrame(rows, TURNS))).collect()}
    assert sorted(got) == [3, 4, 6, 7, 8, 9] and got[3]["n_snapshots"] == 2 and got[3]["n_turns"] == 3
    assert got[4]["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.render(chat.maximal(spark.createDataFrame([], TURNS))).count() == 0


# op5


@pytest.fixture(scope="module")
def vocab():
    return pieces.pieces(pieces.load(pieces.DEFAULT_MODEL))


TEXTS = ["", " ", "Hello  world\n\nfoo  ", " a", "x\t y　é́ fi", "日本語😀 x", "a▁b", "▁", "\U0010ffff", "\x00\x7f", "word " * 50]


def test_without_dropout_ids_are_the_library_s(vocab, spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = [t for t in TEXTS if pieces.MARK not in t] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        assert sentencepieces.encode_text(t, vocab, sentencepieces.Memory(1), 1, 0.0, 1, 0).tolist() == sp.encode(t)


def test_dropout_is_lossless_seeded_and_varied(vocab):
    for t in TEXTS:
        for seed in (1, 2):
            assert sentencepieces.decode_ids(sentencepieces.encode_text(t, vocab, sentencepieces.Memory(limit=9), 3, 0.3, 4, seed).tolist(), vocab) == t
    t = " ".join(["segmentation"] * 60)
    a = sentencepieces.encode_text(t, vocab, sentencepieces.Memory(limit=9), 3, 0.2, 4, 1).tolist()
    assert a == sentencepieces.encode_text(t, vocab, sentencepieces.Memory(limit=9), 3, 0.2, 4, 1).tolist() != sentencepieces.encode_text(t, vocab, sentencepieces.Memory(limit=9), 3, 0.2, 4, 2).tolist()
    assert len(a) > len(sentencepieces.encode_text(t, vocab, sentencepieces.Memory(limit=9), 3, 0.0, 4, 1))
    cuts = {tuple(sentencepieces.segment("▁segmentation", vocab, 0.2, k * 7919)) for k in range(40)}
    assert len(cuts) > 5
    all_dropped = sentencepieces.segment("▁the", vocab, 1.0, 5)
    assert len(all_dropped) == 4


def test_sentencepiece_edges(spark):
    docs = edge_docs(spark, EXTRA)
    out = sentencepieces.encode(docs)
    rows = sentencepieces.decode(out, "ids", "again").collect()
    texts = sorted((str(r["doc_id"]), str(r["text"])) for r in docs.collect())
    assert all(r["lossless"] for r in rows) and sorted((str(r["doc_id"]), str(r["again"])) for r in rows) == texts
    assert all((r["ids"] is None) == (r["n_tokens"] is None) for r in rows)
    assert sentencepieces.encode(empty_docs(spark)).count() == 0


# op6


def brute_repeats(docs, window=20):
    first, key = {}, {}
    order = sorted(docs, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r in order:
        w = split(r["text"])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (r["doc_id"], s))
    for r in order:
        w = split(r["text"])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (r["doc_id"], s):
                gone[s : s + window] = [True] * window
        key.setdefault(r["doc_id"], []).append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return key


def test_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_repeats(docs)
    got = {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in QUERIES["op6_substring_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_substring_random(spark):
    """Few words, so windows overlap themselves and each other."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + " " + "z " * rng.randint(0, 45), "en", "a", 1) for i in range(40)]
    docs = edge_docs(spark, rows=rows)
    got = substring.remove_repeats(docs, window=6, phrase=3)
    kept = F.sha2(F.array_join(common.words(F.col("text")), " ").cast("binary"), 256)
    assert {r[0]: [tuple(r)[1:]] for r in got.select("doc_id", "n_words", "n_removed", kept).collect()} == brute_repeats(docs.collect(), 6)


def test_substring_edges(spark):
    docs = edge_docs(spark, EXTRA)
    out = substring.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"] and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[4]["n_removed"] == 0 and got[5]["n_removed"] == 70 and got[5]["text"] == ""
    assert got[8]["n_removed"] == 59 and got[11]["text"] == "tail" or got[11]["n_removed"] > 0
    unnamed = [r for r in out.collect() if r["doc_id"] is None and r["n_words"]]
    assert unnamed[0]["n_removed"] == 70
    assert substring.remove_repeats(empty_docs(spark)).count() == 0


def test_cut_keeps_white_space():
    t = b"  a b\n\nc\td "
    assert substring.cut(t, np.array([False, True, False, False])) == b"  a c\td "
    assert substring.cut(t, np.array([False, False, False, True])) == b"  a b\n\nc\t"


# op7


def brute_nearest(ids, x, q, k):
    i = ids.index(q)
    scores = x @ x[i]
    order = np.lexsort((np.array(ids), -scores))
    return [(ids[j], scores[j]) for j in order if j != i][:k]


def test_ann_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = {}
    for r in QUERIES["op7_ann"](spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    hit = 0
    for q, got in found.items():
        want = brute_nearest(ids, x, q, 20)
        hit += len({v for v, _ in want} & {v for v, _ in got})
        assert len(got) == 20 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        assert all(s == pytest.approx(float(x[ids.index(v)] @ x[ids.index(q)])) for v, s in got)
    assert hit / (20 * len(found)) >= 0.9


def test_ann_copies_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (None, [1.0, 1.0]), (120, [3.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == [0, 20, 40, 100, 120]
    assert got[0] == [120, *range(1, 20)] and got[20] == [120, *range(0, 19)] and len(got[120]) == 20 and 120 not in got[120]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id IN (100, 120)"), F.col("vec_id") == 100).collect()[0]["vec_id"] == 120


def test_forest_descends_to_longest_prefixes():
    x = np.random.default_rng(2).normal(size=(500, 8))
    forest = ann.Forest(x, trees=4, bits=16)
    own = [forest.strings(np.c_[x[:5], np.zeros(5)], p) for p in forest.planes]
    for enough in (1, 60, 2000):
        lo, hi = forest.ranges(x[:5], enough)
        for q in range(5):
            under = lambda n: [int(((h >> np.uint64(16 - n)) == (own[t][q] >> np.uint64(16 - n))).sum()) for t, (h, _) in enumerate(forest.trees)]  # noqa: E731, B023
            length = max(n for n in range(17) if sum(under(n)) >= enough or n == 0)
            assert (hi[:, q] - lo[:, q]).tolist() == under(length)


# op8


def brute_components(ids, fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["data", "edges"])
def test_simhash(spark, sf_dir, which):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "data" else edge_docs(spark, EXTRA)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(str((r["doc_id"], f, c)) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps), strict=True))
    got = sorted(str((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_simhash_ball(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for f in base:
        for k in (1, 2, 3):
            for b in rng.sample(range(64), k):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")), common.settle).collect()
    roots = {r["node"]: r["component"] for r in found}
    part = brute_components(list(range(len(fps))), fps)
    for i, j in combinations(range(len(fps)), 2):
        assert (part[i] == part[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_keep_one(spark):
    docs = edge_docs(spark, EXTRA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted(set(ids)) and 1 in ids and 4 in ids and 5 not in ids and 2 not in ids
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0 and simhash.keep_one(empty_docs(spark)).count() == 0


# op9


def brute_quality(t):
    body = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", body)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {p for g in grams.values() if len(g) > 1 for i in g for p in (i, i + 1, i + 2)}
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(body.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark):
    docs = edge_docs(spark, EXTRA)
    got = sorted(str(tuple(r)) for r in quality.assess(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(str((r["doc_id"], *brute_quality(r["text"]))) for r in docs.collect())


def test_quality_verdicts(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120))
    rows = [(0, prose), (1, prose.upper()), (2, "same words here " * 40), (3, " | ".join(prose.split())), (4, "\n".join(["a b c d e f"] * 30)), (5, prose.replace(" ", "!!! ")), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.assess(docs, ["doc_id"]).collect()}
    assert [i for i, r in got.items() if r["kept"]] == [0]
    assert got[6]["base_failed"] and got[2]["base_failed"] and not got[1]["base_failed"]
    assert [r["doc_id"] for r in quality.quality_filter(docs).collect()] == [0]
    assert quality.assess(empty_docs(spark), ["doc_id"]).count() == 0


def test_cascade_orders_by_rejection_per_cost(spark):
    df = spark.range(200)
    rule = lambda name, below, *needs: quality.Rule(name, F.col("id") < below, needs)
    found = [rule("dull", 0, "n_words"), rule("dear", 100, "n_repeat_words"), rule("cheap", 90, "n_words"), rule("like_cheap", 80, "n_words", "word_chars")]
    masks = {}
    for i in range(200):
        mask = tuple(i < below for below in (0, 100, 90, 80))
        masks[mask] = masks.get(mask, 0) + 1
    size = {"chars": 1000.0, "words": 200.0, "lines": 10.0, "sort": 1500.0}
    # after the cheap one, what is like it rejects nothing more; the dear one still does
    assert [r.name for r in quality.order_rules(found, masks, size)] == ["cheap", "dear", "dull", "like_cheap"]
    assert df.where(quality.cascade(found)).count() == 100


def test_the_cascades_order_is_the_same_on_every_rerun(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("body", F.coalesce("text", F.lit("")))
    orders = {tuple(r.name for r in quality.ordered_rules(docs, "text", "body", n)) for n in (100, 100, 100)}
    assert len(orders) == 1 and len(next(iter(orders))) == len(quality.rules("body"))


def test_a_filter_above_the_counts_stays_there(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality.assess(docs, ["doc_id"])
    plan = found.where("kept AND n_repeat_words < 9 AND n_words > 60")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Generate", 1)[1]
    # conditions on the text alone may go to the scan; none that holds a count's expression does
    assert not [x for x in below.splitlines() if "Filter" in x and ("transform(" in x or "xxhash64" in x or "split(" in x)]
    assert found.where("kept AND n_words > 60").count() == sum(r["kept"] and r["n_words"] > 60 for r in found.collect())


# op10


def brute_count(text, vocab, scores):
    m = pieces.marked(text)
    best = [(0.0, 0)]
    for i in range(1, len(m) + 1):
        options = []
        for j in range(max(0, i - vocab.longest), i):
            got = scores.get(m[j:i])
            if got is not None:
                options.append((best[j][0] + got, best[j][1] - 1))
            elif j == i - 1:
                size = 3 if m[j] == pieces.LITERAL else len(m[j].encode())
                options.append((best[j][0] + size * tokencounts.BYTE_SCORE, best[j][1] - size))
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark, sf_dir, vocab):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text").unionByName(edge_docs(spark).where("doc_id <> 6 AND doc_id <> 11").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    scores = tokencounts.unigram_scores(vocab)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.token_counts(docs).collect()}
    assert got == {r["doc_id"]: brute_count(r["text"] or "", vocab, scores) for r in docs.collect()}


def test_trie_shares_prefixes(vocab):
    scores = tokencounts.unigram_scores(vocab)
    words = ["▁" + w for w in ("in", "inter", "international", "internal", "x", "")]
    assert tokencounts.trie_counts(words, scores, vocab.longest) == {w: brute_count(w[1:], vocab, scores) if w != "▁" else 1 for w in words}


def test_token_count_edges(spark):
    docs = edge_docs(spark, EXTRA)
    assert tokencounts.token_counts(docs).count() == docs.count() and tokencounts.token_counts(empty_docs(spark)).count() == 0


# pipeline


def brute_similar(ids, texts):
    """The smallest id of each text's component; five-word shingles of a similarity of 0.8 or more link texts, as in every near-duplicate stage."""
    sets = []
    for t in texts:
        w = split((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = common.settle(corpus_pipeline.quality_rules(spark, docs, sf_dir))
    want = {r["doc_id"] for r in quality.assess(docs, ["doc_id"]).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    heads = common.settle(corpus_pipeline.simhash_dedup(spark, kept, sf_dir))
    rows = kept.collect()
    parts = brute_similar([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in heads.collect()) == sorted(set(parts))
    cut = common.settle(corpus_pipeline.substring_dedup(spark, heads, sf_dir))
    brute = brute_repeats(heads.collect())
    for r in cut.collect():
        assert brute[r["doc_id"]][0][2] == hashlib.sha256(b" ".join(split(r["text"]))).hexdigest() and r["n_chars"] == len(r["text"])
    mixed = common.settle(corpus_pipeline.source_mixing(spark, cut, sf_dir))
    reads = {}
    for r in mixing.mix(cut).collect():
        n = sum(2 * p["taken"] >= r["size"] for p in r["passes"])
        if n:
            reads[r["id"]] = n
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == reads and mixed.columns == docs.columns
    last = corpus_pipeline.sentencepiece(spark, mixed, sf_dir).collect()
    assert len(last) == sum(reads.values()) and all(r["lossless"] for r in last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "source_mixing", "sentencepiece"]


def test_pipeline_edges(spark):
    for docs in (edge_docs(spark, EXTRA), empty_docs(spark)):
        now = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = common.settle(stage(spark, now, ""))
            if i < 4:
                assert now.columns == docs.columns
