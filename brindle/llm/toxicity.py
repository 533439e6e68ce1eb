"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of clauses. Within a clause, words become symbols and run through a cascade of transducers, composed
into two (one reads the clause forwards, one backwards, as what a clause says of its target may stand on either side):

    lexicon     word -> INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT or nothing; insults carry a learned weight
    negation    INSULT or THREAT within a few words after NEGATION is negated
    intent      THREAT within a few words after INTENT is purposed ("I will ... hurt")
    reported    INSULT or THREAT after REPORT in the clause is reported
    target      INSULT or THREAT after a TARGET in the clause is targeted; backwards, the same for those before one

What comes out is a weighted count for each form, and a logistic score over these counts and the most hostile clause. So a
clause is scored as a whole: the same word counts less under a negation or in reported speech and more beside a second
person, and a threat counts most with an intent and a target. Negation, report, target, intent and threat words are fixed
lists; insults, being unknown in general, are learned: words and word beginnings that are far more frequent in documents
labelled toxic.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh, read, settle

#: Labelled rows from which lexicon and weights are learned, about: a hash of the id picks them when there are more.
SAMPLE_ROWS = 12_000
#: A learned insult is in this many toxic documents at least, and this many times more frequent in them.
MIN_DOCS = 5
MIN_LIFT = 12.0
PREFIXES = range(4, 9)
#: Words after a negation, and after an intent, that it reaches.
NEGATION_REACH = 3
INTENT_REACH = 4
FOLDS = 5

# The closed word classes, in the corpus' languages.
THREATS = "kill hurt destroy burn beat stab shoot crush punish töten schlagen vernichten verbrennen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself u ya du dich dir dein deine euch tu te toi ton ta vous votre usted ustedes tú ti".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais ne nunca ningún".split()
INTENTS = "will shall gonna going want wants should hope i'll we'll werde wirst wollen will sollte vais allons veux voy vamos quiero voulons espère".split()
REPORTS = "said says say told called wrote writes quoted reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = "IXTNRW"
#: A hostile symbol is INSULT or THREAT with the marks it has got, in this order: negated, purposed, reported, targeted.
MARKS = "nprt"
HOSTILE = tuple(base + "".join(m) for base in (INSULT, THREAT) for k in range(len(MARKS) + 1) for m in combinations(MARKS, k))
SYMBOLS = ("", TARGET, NEGATION, REPORT, INTENT, *HOSTILE)


def marked(symbol: str, mark: str) -> str:
    """A hostile symbol with a mark more."""
    return symbol[0] + "".join(m for m in MARKS if m in symbol or m == mark)


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over SYMBOLS: moves maps (state, symbol) to (state, symbol, weight factor); state 0 is the first."""

    moves: dict[tuple[int, str], tuple[int, str, float]]

    def __call__(self, line: list[tuple[str, float]]) -> list[tuple[str, float]]:
        state, out, moves = 0, [], self.moves
        for symbol, weight in line:
            state, symbol, factor = moves[state, symbol]
            out.append((symbol, weight * factor))
        return out

    def then(self, after: Transducer) -> Transducer:
        """The composition: after, reading what this one writes, as one transducer over pairs of states."""
        names, moves, todo = {(0, 0): 0}, {}, [(0, 0)]
        for pair in todo:
            for symbol in SYMBOLS:
                p, middle, w = self.moves[pair[0], symbol]
                q, out, v = after.moves[pair[1], middle]
                if (p, q) not in names:
                    names[p, q] = len(names)
                    todo.append((p, q))
                moves[names[pair], symbol] = (names[p, q], out, w * v)
        return Transducer(moves)


def reaching(start: str, mark: str, reach: int | None, bases: str) -> Transducer:
    """Marks hostile symbols of these bases within reach words (None: to the clause's end) after the symbol start."""
    top = 1 if reach is None else reach
    moves = {}
    for k in range(top + 1):
        for symbol in SYMBOLS:
            rest = k if reach is None else max(0, k - 1)
            hit = k > 0 and symbol[:1] in bases and symbol in HOSTILE
            moves[k, symbol] = (top if symbol == start else rest, marked(symbol, mark) if hit else symbol, 1.0)
    return Transducer(moves)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    return reaching(NEGATION, "n", reach, INSULT + THREAT)


def intent(reach: int = INTENT_REACH) -> Transducer:
    return reaching(INTENT, "p", reach, THREAT)


def reported() -> Transducer:
    return reaching(REPORT, "r", None, INSULT + THREAT)


def target() -> Transducer:
    return reaching(TARGET, "t", None, INSULT + THREAT)


_FORWARDS = negation().then(intent()).then(reported()).then(target())
_BACKWARDS = target()
#: What is counted: reported before negated before the others; purposed and targeted threats apart.
FORMS = ("I", "It", "In", "Ir", "X", "Xp", "Xt", "Xpt", "Xn", "Xr")


def form(symbol: str) -> str:
    """The form that a hostile symbol counts as."""
    return symbol[0] + ("r" if "r" in symbol else "n" if "n" in symbol else "".join(m for m in "pt" if m in symbol and (m == "t" or symbol[0] == THREAT)))


_PLACE = {x: FORMS.index(form(x)) for x in HOSTILE}


def clause_counts(line: list[tuple[str, float]]) -> np.ndarray:
    """The weight of each form in a clause of symbols."""
    out = np.zeros(len(FORMS))
    for symbol, weight in _BACKWARDS(_FORWARDS(line)[::-1]):
        at = _PLACE.get(symbol)
        if at is not None:
            out[at] += weight
    return out


@dataclass(frozen=True)
class Grammar:
    """insults: word or, ending in *, word beginning -> weight; coef and bias of the logistic score over features()."""

    insults: tuple[tuple[str, float], ...]
    coef: tuple[float, ...] = ()
    bias: float = 0.0


@lru_cache(maxsize=4)
def _compiled(grammar: Grammar):
    """The lexicon transducer: one automaton over characters that locates insults and threats at word starts."""
    automaton = ahocorasick.Automaton()
    forms = [(" " + w[:-1] if w.endswith("*") else f" {w} ", INSULT, weight) for w, weight in grammar.insults]
    for form, symbol, weight in [*forms, *((f" {w} ", THREAT, 1.0) for w in THREATS)]:
        automaton.add_word(form, (symbol, weight, len(form)))
    automaton.make_automaton()
    classes = {w: INTENT for w in INTENTS} | {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
    return automaton, classes


def clauses_with_hits(text: str, grammar: Grammar) -> Iterator[list[tuple[str, float]]]:
    """The symbols of each clause of a text that has an insult or a threat."""
    automaton, classes = _compiled(grammar)
    for clause in _CLAUSE.split(text.lower()):
        if len(clause) < 3:
            continue
        line = " " + " ".join(_WORD.findall(clause)) + " "
        hits: dict[int, tuple[str, float]] = {}
        for end, (symbol, weight, size) in automaton.iter(line):
            at = end - size + 2
            if at not in hits or weight > hits[at][1]:
                hits[at] = (symbol, weight)
        if not hits:
            continue
        symbols, at = [], 1
        for word in line.split():
            symbols.append(hits.get(at) or (classes.get(word, ""), 0.0))
            at += len(word) + 1
        yield symbols


def features(text: str | None, grammar: Grammar) -> np.ndarray:
    """Of a whole text: log of one plus the weight of each form, the highest clause, whether there is any, and the share of words."""
    total, top, n = np.zeros(len(FORMS)), 0.0, 0
    for line in clauses_with_hits(text or "", grammar):
        found = clause_counts(line)
        total += found
        top = max(top, float(found.sum()))
        n += 1
    return np.r_[np.log1p(total), math.log1p(top), float(n > 0), math.log1p(n)]


N_FEATURES = len(FORMS) + 3


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def learn_insults(sample: DataFrame) -> list[tuple[str, float]]:
    """Words and word beginnings by how much more frequent they are in toxic documents. sample: (text, toxic).

    Document frequencies are aggregated by Spark over the sample; only the lexicon comes to the driver, whose size the sample
    bounds: each entry is in MIN_DOCS of its toxic documents at least.
    """
    sample = sample.groupBy(F.xxhash64("text").alias("id")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))  # copies count once
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+(?:'[\p{L}]+)?)"), 1)))
    seen = sample.select("id", "toxic", word.alias("w"))
    forms = F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES])
    seen = seen.select("id", "toxic", F.explode(F.array_compact(forms)).alias("w")).distinct()
    total = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not total or not total[0] or not total[1]:
        return []
    counts = seen.groupBy("w").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    lift = ((F.col("pos") + 0.5) / float(total[0])) / ((F.col("neg") + 0.5) / float(total[1]))
    rows = counts.withColumn("lift", lift).where((F.col("pos") >= MIN_DOCS) & (F.col("lift") >= MIN_LIFT))
    found = rows.orderBy(F.desc("pos"), F.desc("lift"), "w").collect()
    return [(r["w"], min(8.0, math.log(r["lift"]))) for r in found]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method for the ridge-penalised logistic loss."""
    z = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar from the labelled rows that are not held out. Without both classes, as of an empty table, it scores everything alike.

    Labels of an id that repeats count as toxic if one of them does; rows that share an id are each read with its label. Whole
    texts are read, however long; null ones are empty. Equal texts count once in the lexicon.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    known = known.select(F.col(id_col).alias("id"), "toxic")
    sample = settle(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id"))
    insults = learn_insults(sample)
    grammar = Grammar(tuple(insults))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, grammar).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    if not insults or rows["toxic"].nunique() < 2:
        mean = float(rows["toxic"].mean()) if len(rows) else 0.0
        return Grammar(grammar.insults, (0.0,) * N_FEATURES, math.log((mean + 1e-3) / (1 - mean + 1e-3)))
    coef, bias = fit_logistic(np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float))
    return Grammar(grammar.insults, tuple(coef.tolist()), bias)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for every row; null and empty texts score as texts without a hostile clause.

    Repeated rows score alike; an empty table gives an empty table; whole texts are read, however long. A result's name that
    id_col has gets underscores added.
    """
    names = [id_col, *(fresh([id_col], c) for c in ("score", "predicted"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef = np.array(grammar.coef)
        for b in batches:
            x = np.array([features(t, grammar) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            p = 1 / (1 + np.exp(-np.clip(x @ coef + grammar.bias, -30, 30))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias(fresh([id_col], "_text"))).mapInArrow(run, f"`{id_col}` {kind}, `{names[1]}` double, `{names[2]}` int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    grammar = learn(docs, read(spark, sf_dir, "labels"))
    return score(docs, grammar).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
