"""Counts of repeated windows where hashes share their upper bits, and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import quality


def repeated(text):
    w = text.split()
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_unlike_hashes_between_equal_ones(spark):
    text = "q148780 z z q157738 z z q148780 z z"
    docs = spark.createDataFrame([(1, text), (2, text + " more words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.assess(docs, ["doc_id"]).collect()}
    assert got == {1: 6, 2: 6, 3: 0} and repeated(text) == 6


@pytest.mark.parametrize("bits", [28, 58, 62])
def test_counts_do_not_depend_on_the_sort_key(spark, monkeypatch, bits):
    """With few hash bits in the sort key, unlike windows interleave."""
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    rng = random.Random(bits)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.assess(docs, ["doc_id"]).collect()}
    assert got == {i: repeated(t) for i, t in rows}


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, 7, True)], "doc_id long, text string, n_words int, kept boolean")
    row = quality.assess(docs, ["doc_id", "n_words", "kept"]).first()
    assert row["n_words"] == 90 and row["kept"] is False and row["base_failed"]
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.assess(docs.where("false"), ["doc_id"]).count() == 0 and quality.quality_filter(docs.where(F.lit(False))).count() == 0
