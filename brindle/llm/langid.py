"""Language identification by hierarchical discrimination.

A text is first given to a language family by one-versus-rest linear scores; within the family, one-versus-one linear
support vector machines separate the closely related languages, and the most votes win (then the largest summed margin).
Inputs are the text's byte n-grams of one to three, hashed to DIM buckets, as square roots of their shares, so that long
and short texts compare. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import fresh, read

DIM = 1 << 13
#: Rows of each language, at most, that the machines are fitted on; a hash of the id picks them.
ROWS_PER_LANGUAGE = 300
#: Rows of all languages together, of 32 kB each, which the driver holds; beyond 26 languages each has fewer rows.
MAX_ROWS = 26 * ROWS_PER_LANGUAGE
#: More languages than this are refused, not dropped: they would have fewer than eight rows each.
MAX_LANGUAGES = 975
#: A text with a match has a letter; the same expression serves learning and predicting.
LETTER = r"\p{L}"
FOLDS = 3
HELD = 1
EPOCHS = 12

# Language families by code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "iranian": "fa ku ps",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he am",
}

_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def family(lang: str) -> str:
    code = lang.lower().split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def vector(text: str) -> np.ndarray:
    """DIM shares of hashed byte n-grams of a whole text, as a unit vector."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)
    out = np.zeros(DIM, dtype=np.float64)
    for at in range(0, len(raw), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(256) + b[1:]
        out += np.bincount(b, minlength=DIM)
        out += np.bincount((two * _M1) >> np.uint32(19), minlength=DIM)
        if len(b) > 2:
            out += np.bincount(((two[:-1] * np.uint32(256) + b[2:]) * _M2) >> np.uint32(19), minlength=DIM)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent; y is 1 or -1."""
    z = np.c_[x, np.ones(len(x), dtype=x.dtype)]
    size, alpha, w = (z * z).sum(axis=1), np.zeros(len(z)), np.zeros(z.shape[1])
    # rare classes weigh as much as common ones
    limit = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(z)):
            grad = y[i] * (z[i] @ w) - 1
            new = min(max(alpha[i] - grad / size[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    """weights: a column for each family (if there are several), then one for each pair of languages of a family."""

    families: tuple[tuple[str, tuple[str, ...]], ...]
    weights: np.ndarray

    def pairs(self) -> list[tuple[str, str]]:
        return [p for _, langs in self.families for p in combinations(langs, 2)]


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = np.array(langs)
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by.setdefault(family(lang), []).append(lang)
    families = tuple((f, tuple(v)) for f, v in sorted(by.items()))
    columns = []
    if len(families) > 1:
        for _, members in families:
            columns.append(svm(x, np.where(np.isin(names, members), 1.0, -1.0)))
    for _, members in families:
        for a, b in combinations(members, 2):
            rows = (names == a) | (names == b)
            columns.append(svm(x[rows], np.where(names[rows] == a, 1.0, -1.0)))
    return Model(families, np.array(columns, dtype=np.float32).T if columns else np.zeros((DIM + 1, 0), dtype=np.float32))


def decide(model: Model, margins: np.ndarray) -> tuple[str, float]:
    """The language of a text with these margins, and a score between 0 and 1."""
    sure, at = 1.0, 0
    squash = lambda m: 1 / (1 + np.exp(-2 * m))
    members = model.families[0][1]
    if len(model.families) > 1:
        at = len(model.families)
        best = int(np.argmax(margins[:at]))
        members, sure = model.families[best][1], float(squash(margins[best]))
    if len(members) == 1:
        return members[0], sure
    votes: dict[str, list[float]] = {m: [0, 0.0] for m in members}
    for pair, margin in zip(model.pairs(), margins[at:], strict=True):
        if pair[0] in votes:
            win, lose = pair if margin >= 0 else pair[::-1]
            votes[win][0] += 1
            votes[win][1] += abs(float(margin))
            votes[lose][1] -= abs(float(margin))
    lang = max(members, key=lambda m: (votes[m][0], votes[m][1]))
    return lang, float(sure * squash(votes[lang][1] / (len(members) - 1)))


def held_out(id_col: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == held


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of every language that has a readable text that is not held out, from at most `rows` texts of each (MAX_ROWS
    in all); None without one, as of an empty table. More than MAX_LANGUAGES languages raise a ValueError. Repeated rows, also
    of one id, are separate rows; ties of the hash that picks go to the smaller id. Whole texts are read, however long."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = labelled.where(F.col(text_col).rlike(LETTER))
    # one row a language; a range of the hash that holds about four times the rows wanted of each
    found = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("size")).limit(MAX_LANGUAGES + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}: none is left out, so none is learned")
    rows = max(1, min(rows, MAX_ROWS // len(found)))
    sizes = docs.sparkSession.createDataFrame([tuple(r) for r in found], "lang string, size long")
    hashed = F.pmod(F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    slim = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("h"))
    near = slim.join(F.broadcast(sizes), "lang").where(F.col("h") <= F.lit(4.0 * rows * (1 << 40)) / F.col("size"))
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vector(t).tobytes() for t in part.column(1).to_pylist()])], names=["lang", "v"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, v binary").toPandas()
    got = got.sort_values(["lang", "v"])
    x = np.array([np.frombuffer(v, dtype=np.float32) for v in got["v"]])
    return fit(x, got["lang"].tolist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; und with score 0 if the text is null or has no letter, or nothing was learned.

    Repeated rows get equal results. Equal votes go to the larger summed margin, then to the language that sorts first. An
    empty table gives an empty table. Whole texts are read, however long. A column id_col of another result's name is kept as it
    is, and that result gets underscores added to its name.
    """
    pred, score = (fresh([id_col], c) for c in ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for at in range(0, b.num_rows, 256):
                texts = b.column(1).slice(at, 256).to_pylist()
                readable = [model is not None and bool(ok) for ok in b.column(2).slice(at, 256).to_pylist()]
                x = np.array([vector(t) for t, ok in zip(texts, readable, strict=True) if ok], dtype=np.float32).reshape(-1, DIM)
                margins = iter(x @ model.weights[:-1] + model.weights[-1]) if model is not None else iter(())
                for ok in readable:
                    lang, sure = decide(model, next(margins)) if ok else ("und", 0.0)
                    langs.append(lang)
                    scores.append(sure)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[id_col, pred, score])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).alias(fresh([id_col], "_text")), F.col(text_col).rlike(LETTER).alias(fresh([id_col], "_readable")))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{pred}` string, `{score}` double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
