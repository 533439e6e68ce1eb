"""No language is left out of the model."""

import random

import pytest

from brindle.llm import langid


def corpus(spark, n):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(10 * k + i, "".join(rng.choice(letters) for _ in range(60)), f"q{k:03d}") for i in range(9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    docs = corpus(spark, 70)
    model = langid.learn(docs)
    assert sorted(x for _, members in model.families for x in members) == [f"q{k:03d}" for k in range(70)]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(corpus(spark, 6))
    assert langid.learn(corpus(spark, 5)) is not None


def test_a_language_of_mostly_unreadable_rows_is_learned(spark):
    rows = [(i, None if i % 300 else "bonjour le monde", "fr") for i in range(60_000)] + [(60_000 + i, "good day to you", "en") for i in range(9)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=1)
    assert {x for _, members in model.families for x in members} == {"en", "fr"}


def test_letters_are_letters(spark):
    docs = corpus(spark, 3)
    odd = spark.createDataFrame([(1, "²½ 12", None), (2, "Ⅷ ①", None), (3, None, None), (4, "", None), (5, "x" + " 1" * 300_000, None), (5, "ª", None)], docs.schema)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, langid.learn(docs)).collect()]
    assert [x for _, x in got[:4]] == ["und"] * 4 and all(x != "und" for _, x in got[4:])
    named = langid.predict(docs.withColumnRenamed("doc_id", "score"), None, id_col="score")
    assert named.columns == ["score", "lang_pred", "score_"] and {r["lang_pred"] for r in named.collect()} == {"und"}


def test_rows_of_one_id_keep_their_languages(spark):
    rows = [(1, "aaa bbb " * 9, "en"), (1, "ççç ééé " * 9, "fr")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert [r["lang_pred"] for r in langid.predict(docs, model).collect()] == ["en", "fr"] * 5


def test_decisions_against_brute_force(spark):
    """The family with the largest margin, then the language that beats most others of it."""
    import numpy as np

    docs = corpus(spark, 4).withColumnRenamed("lang", "l")
    from pyspark.sql import functions as F

    names = {"q000": "en", "q001": "de", "q002": "nl", "q003": "ru"}
    docs = docs.select("doc_id", "text", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("l")].alias("lang"))
    model = langid.learn(docs)
    columns = iter(model.weights.T)
    family = {f: next(columns) for f, _ in model.families}
    pairs = {p: next(columns) for p in model.pairs()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        x = np.r_[langid.vector(r["text"]).astype(float), 1.0]
        best = max(family, key=lambda f: family[f] @ x)
        members = dict(model.families)[best]
        wins = {m: [0, 0.0] for m in members}
        for (a, b), w in pairs.items():
            if a in wins:
                m = w @ x
                wins[a if m >= 0 else b][0] += 1
                wins[a][1] += m
                wins[b][1] -= m
        assert got[r["doc_id"]] == max(members, key=lambda m: (wins[m][0], wins[m][1])) == r["lang"]
