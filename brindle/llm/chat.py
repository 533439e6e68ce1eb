"""Chat formatting with cumulative-snapshot collapse.

Chat systems often log a conversation again after each turn. A rolling SHA-256 over a conversation's turns gives the hash of
each of its prefixes. A conversation whose whole hash is a proper prefix hash of another one is a snapshot of it: an
anti-join drops it, and of equal conversations the smallest conv_id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import read, settle

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>"


def _framed(c: Column) -> Column:
    """c with its length ahead, so that no two turns run into the same string; null differs from empty."""
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("null:"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes): turns in order of turn (then role and text), and the rolling hash after each one.

    One row holds one conversation, as its rendered text does; conversations are independent.
    """
    rows = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    empty = F.array().cast("array<string>")
    rolled = F.aggregate("turns", empty, lambda a, t: F.concat(a, F.array(F.sha2(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), _framed(t["role"]), _framed(t["text"])), 256))))
    return rows.withColumn("prefixes", rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_snapshots) of the conversations that no other one continues; n_snapshots counts equal conversations, itself included.

    Turn numbers only order a conversation. Null roles and texts are turns like any other and differ from empty ones; rows
    with a null conv_id belong to no conversation. An empty table gives an empty table.
    """
    found = settle(conversations_of(turns))
    whole = found.select("conv_id", F.get("prefixes", F.size("prefixes") - 1).alias("hash"))
    # a common first turn is one prefix of very many conversations: distinct collapses it before the shuffle
    prefixes = found.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("hash")).distinct()
    once = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    kept = once.join(prefixes, "hash", "left_anti").select("conv_id", "n_snapshots")
    return found.join(kept, "conv_id").select("conv_id", "turns", "n_snapshots")


def render(found: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, chat): each turn between START role and END; null roles and texts are empty."""
    turn = lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n"))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_snapshots", F.array_join(F.transform("turns", turn), "").alias("chat"))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    return render(maximal(read(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, list(coalesce(role, '~') || chr(1) || coalesce(text, '~') ORDER BY turn, role, text) AS t,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT DISTINCT t[1:n] AS t FROM (SELECT t, unnest(range(1, len(t))) AS n FROM c)),
o AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM c GROUP BY t)
SELECT c.conv_id, CAST(len(c.t) AS BIGINT) AS n_turns, n_snapshots, chat
FROM o JOIN c ON o.conv_id = c.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = o.t)
"""
