"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, neardup, quality, sentencepieces, simhash, substring
from brindle.llm.common import fresh, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.quality_filter(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. SimHash fingerprints link documents as
    in op8 (three words, 2 of 64 bits); five-word shingles of a similarity of 0.8 or more link those that fingerprints miss."""
    return neardup.keep_one(docs, radius=simhash.RADIUS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go; n_chars follows the text."""
    out = substring.remove_repeats(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, range-sorted in training order."""
    return mixing.training_order(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with merge-dropout, and its place in the training order; each place draws its own skips."""
    place = fresh(docs.columns, "place")
    return sentencepieces.encode(mixing.placed(docs, place), pass_col=place, keep_pass=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express SimHash components, the training order or merge-dropout; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
