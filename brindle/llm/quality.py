"""Quality rules as a short-circuit cascade (native: DataFrame expressions only).

Every rule is a column that is true where it rejects, over counts that it names. One job over a random sample of all rows
finds which rules reject which rows and how much there is to count: characters, words, lines, and what sorting them takes. A
rule's cost is the work of the counts that it needs beyond those that rules before it have left, in nanoseconds by
the rates of WORK; no run is timed, so the order is the same on every rerun. The cascade takes, again and again, the rule with the most rejections per
cost among the rows of the sample that are left. quality_filter() then computes a rule's counts only for the rows that the
rules before it have passed. The order changes the time, never the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, fresh, read, words

#: Rows of the sample on which cost and selectivity are estimated, about. Only the order of the rules depends on it.
SAMPLE_ROWS = 2_000
SEED = 23
#: Nanoseconds of work: of each count, and of a rule's own expression, by what it goes through. Measured once, on one core.
WORK = {
    "n_words": {"chars": 9.0}, "word_chars": {"chars": 17.0}, "n_symbols": {"chars": 24.0}, "n_lines": {"chars": 54.0}, "n_dup_lines": {"chars": 6.0, "lines": 100.0},
    "n_repeat_words": {"words": 1500.0, "sort": 50.0}, "marks": {"chars": 6.0}, "upper": {"chars": 50.0}, "letters": {"chars": 50.0},
}

# The limits of the rules.
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
SYMBOLS = "#*$%&|<>"
DUP_LINE_PERCENT = 50
SHOUT_PERCENT = 60
EXCLAIM_PERCENT = 50
LETTER_PERCENT = 50
WORD_LENGTH = (2.0, 12.0)

#: A word position takes this many low bits of a sort key; the rest are hash bits.
POSITION_BITS = 28


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_text_stats(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, the text as a column of its own, and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines that keep lacks.

    n_repeat_words marks every word in a 3-word window found at least twice in its text. The 64-bit hashes of the windows
    are sorted with their positions in one array of longs, upper hash bits first, so equal windows become neighbours: n log n
    for any text, no shuffle. In the rare text where unlike hashes agree in those upper bits, and so may part equal ones,
    whole hashes are sorted instead. Null texts count as empty.
    """
    c, w, t, s, m = (fresh(keep, x) for x in ("_text", "_words", "_windows", "_sorted", "_size"))
    low = (1 << POSITION_BITS) - 1
    out = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(c))
    out = out.select(*keep, c, words(F.col(c)).alias(w))
    n = F.size(w)
    out = out.select(
        *keep, c, n.cast("long").alias(m),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias(t),
    )
    packed = F.sort_array(F.transform(F.col(t), lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(t)) < F.size(t), packed).otherwise(F.array().cast("array<bigint>")))
    at = lambda key: F.get(F.col(t), key.bitwiseAND(F.lit(low)).cast("int"))
    after = lambda k: F.get(F.col(s), k + 1)
    mixed = F.filter(F.col(s), lambda x, k: (F.shiftright(x, POSITION_BITS) == F.shiftright(after(k), POSITION_BITS)) & (at(x) != at(after(k))))
    pairs = F.sort_array(F.transform(F.col(t), lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    out = out.withColumn(s, F.when(F.size(mixed) > 0, F.transform(pairs, lambda p: p["i"])).otherwise(F.col(s)))
    again = F.filter(F.col(s), lambda x, k: (at(x) == at(F.get(F.col(s), k - 1))) | (at(x) == at(after(k))))
    first = F.transform(again, lambda x: x.bitwiseAND(F.lit(low)))
    lines = F.filter(F.split(F.col(c), "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    out = out.select(*keep, c, m, first.alias(s), lines.alias(t))
    counts = {
        "n_words": F.col(m),
        "word_chars": _without(F.col(c), SPACE_CHARS),
        "n_symbols": F.length(c) - _without(F.col(c), SYMBOLS),
        "n_dup_lines": F.size(t) - F.size(F.array_distinct(t)),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform(F.col(s), lambda p: F.array(p, p + 1, p + 2))))),
        "n_lines": F.size(t),
    }
    return out.select(*keep, c, *[v.cast("long").alias(k) for k, v in counts.items() if k not in keep])


#: Columns that assess() adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """rejects: true where the rule rejects a row (never null); needs: the counts of with_text_stats() that it reads; work: what of WORK its own expression does."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()
    work: tuple[str, ...] = ()


def rules(text: str) -> list[Rule]:
    """The verdict's rules over the counts of with_text_stats() and the text column."""
    body, n_words = F.col(text), F.col("n_words")
    upper, letters = F.regexp_count(body, F.lit(r"\p{Lu}")), F.regexp_count(body, F.lit(r"\p{L}"))
    marks = F.length(body) - _without(body, "!")
    return [
        Rule("few_words", n_words < MIN_WORDS, ("n_words",)),
        Rule("repeats", 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n_words, ("n_words", "n_repeat_words")),
        Rule("symbols", 100 * F.col("n_symbols") > SYMBOL_PERCENT * n_words, ("n_words", "n_symbols")),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("word_length", (F.col("word_chars") < WORD_LENGTH[0] * n_words) | (F.col("word_chars") > WORD_LENGTH[1] * n_words), ("n_words", "word_chars")),
        Rule("exclaims", 100 * marks > EXCLAIM_PERCENT * n_words, ("n_words",), ("marks",)),
        Rule("shouts", 100 * upper > SHOUT_PERCENT * letters, (), ("upper", "letters")),
        Rule("few_letters", 100 * letters < LETTER_PERCENT * F.col("word_chars"), ("word_chars",), ("letters",)),
    ]


def order_rules(found: list[Rule], masks: dict[tuple[bool, ...], int], size: dict[str, float]) -> list[Rule]:
    """The rules by rejections per cost, best first. masks: how many rows of the sample have these verdicts, rule by rule; size:
    what a row has on average of what WORK counts. Rejections are of rows that no rule before rejects, costs of counts that no
    rule before needs; a rule that rejects nothing more comes last, cheapest first, and equals go by name."""
    left, have, out = dict(masks), set(), []
    while len(out) < len(found):
        rows, best = max(1, sum(left.values())), None
        for k, rule in enumerate(found):
            if rule in out:
                continue
            cost = 1.0 + sum(rate * size[what] for part in {*rule.needs, *rule.work} - have for what, rate in WORK[part].items())
            share = sum(n for mask, n in left.items() if mask[k]) / rows
            key = (-share / cost, cost, rule.name)
            if best is None or key < best[0]:
                best = (key, k)
        k = best[1]
        out.append(found[k])
        have |= {*found[k].needs, *found[k].work}
        left = {mask: n for mask, n in left.items() if not mask[k]}
    return out


def _apart(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """keep, and values as columns that no filter above moves below: they come out of a one-row generator, so that they are
    computed once a row, whatever is asked of them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _with_counts(df: DataFrame, text: str, counts: list[str]) -> DataFrame:
    """df with these counts of its text column; the others are pruned and cost nothing."""
    return with_text_stats(df, text, df.columns).select(*df.columns, *counts) if counts else df


def ordered_rules(docs: DataFrame, text: str, body: str, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules over the text column body, in the order that pays on a sample of all rows of docs: two jobs, a count and the sample's."""
    found, n = rules(body), docs.count()
    if not n:
        return found
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias(body)).sample(False, min(1.0, sample_rows / n), SEED)
    stats = with_text_stats(sample, body, [body])
    stats = _apart(stats, [body], {c: F.col(c) for c in dict.fromkeys(x for r in found for x in r.needs)})
    chars, n_words = F.length(body).cast("double"), F.col("n_words").cast("double")
    sizes = {"chars": chars, "words": n_words, "lines": F.col("n_lines").cast("double"), "sort": n_words * F.log2(n_words + 1)}
    judged = stats.select(F.array(*[r.rejects for r in found]).alias("mask"), *[v.alias(k) for k, v in sizes.items()])
    seen = judged.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in sizes]).collect()  # 2 ^ rules rows at most
    rows = max(1, sum(r["n"] for r in seen))
    # rounded, so that the order of a sum does not decide
    size = {k: round(sum(r[k] for r in seen) / rows, 3) for k in sizes}
    return order_rules(found, {tuple(r["mask"]): r["n"] for r in seen}, size)


def cascade(found: list[Rule]) -> Column:
    """True where any rule rejects; OR stops at the first true operand."""
    out = found[0].rejects
    for rule in found[1:]:
        out = out | rule.rejects
    return out


def assess(docs: DataFrame, keep: list[str], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """keep, the counts, base_failed and kept for every row of docs.

    Empty and null texts have no words and fail. Repeated rows are judged one by one. An empty table gives an empty table.
    Columns of keep that have the name of a count or a verdict are replaced by it. Texts may be of any length.
    """
    keep = [c for c in keep if c.lower() not in RESULTS]
    stats = with_text_stats(docs, text, keep)
    body = stats.columns[len(keep)]
    found = ordered_rules(docs, text, body, sample_rows)
    stats = _apart(stats, [*keep, body], {c: F.col(c) for c in stats.columns[len(keep) + 1 :]})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~cascade(found)).drop(body, "n_lines")


def quality_filter(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that every rule passes, with docs' columns as they are.

    Rule by rule, counts first: rows that a rule rejects reach no later one. Counts and verdicts stand apart (_apart), so the
    optimiser moves no rule before another.
    """
    now, have = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body")), []
    for rule in ordered_rules(docs, text, "body", sample_rows):
        more = [c for c in rule.needs if c not in have]
        now = _apart(_with_counts(now, "body", more), ["row", "body", *have], {**{c: F.col(c) for c in more}, "rejects": rule.rejects}).where(~F.col("rejects")).drop("rejects")
        have += more
    return now.select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"), ["doc_id"])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, body, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
f AS (
  SELECT s.doc_id, body, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) AS upper_n,
    length(regexp_replace(body, '[^\p{L}]', '', 'g')) AS letters, length(body) - length(replace(body, '!', '')) AS marks
  FROM s LEFT JOIN rep ON s.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2.0 * n_words OR word_chars > 12.0 * n_words OR 100 * marks > 50 * n_words
    OR 100 * upper_n > 60 * letters OR 100 * letters < 50 * word_chars) AS kept
FROM f
"""
