"""Text operators: token vocabularies and encodings, document tokens, document-frequency filters, topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import row_index
from brindle.sources.tables import settle

# Line-notation tokens (brackets, two-letter elements, letters, bonds, digits) and special tokens.
TWO_LETTERS = "Cl|Br|Si|Se|Na|Ca|Li|Mg|Zn|Fe|Cu|Mn|Hg|Sn|As|Bi|Cd|se|Cr|Sb"
SMILES_TOKEN = rf"(\[|\]|{TWO_LETTERS}|[A-Z]|[a-z]|[=#/\\().+\-:]|\d)"
DEEPSMILES_TOKEN = rf"(\[|\]|{TWO_LETTERS}|[A-Z]|[a-z]|[=#/\\.+\-:]|\)+|\(+|\d)"
SELFIES_TOKEN = r"(\[.*?\])"
TOKENS = {"smiles": SMILES_TOKEN, "deepsmiles": DEEPSMILES_TOKEN, "selfies": SELFIES_TOKEN}
PAD, UNK = "<pad>", "<unk>"
# English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


def tokens(text: Column | str, pattern: str = SMILES_TOKEN) -> Column:
    """The pattern's matches, in order; null for null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(1))


def alphabet(df: DataFrame, text: str, pattern: str = SMILES_TOKEN, size: int | None = None) -> DataFrame:
    """(token, code): PAD first, then tokens by count (the token itself on ties), UNK last. Bounded by the distinct tokens."""
    counts = df.select(F.explode(tokens(text, pattern)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    if size is not None:
        counts = counts.orderBy(F.desc("n"), "token").limit(size)
    ranked = row_index(counts, F.desc("n"), "token", name="code").select("token", (F.col("code") + 1).cast("int").alias("code"))
    ends = counts.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit(PAD).alias("token"), F.lit(0).alias("code")), F.struct(F.lit(UNK).alias("token"), (F.col("n") + 1).cast("int").alias("code")))).alias("e")).select("e.*")
    return ends.unionByName(ranked)


def encode_tokens(df: DataFrame, text: str, codes: Sequence[str], width: int, out: str = "tokens", pattern: str = SMILES_TOKEN) -> DataFrame:
    """Codes of the tokens, padded to width; unknown tokens take the last code. A text with more tokens than width is an error."""
    table = F.map_from_arrays(F.array(*map(F.lit, codes)), F.sequence(F.lit(0), F.lit(len(codes) - 1)))
    found = F.transform(tokens(text, pattern), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(len(codes) - 1)))
    padded = F.concat(found, F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - F.size(found))))
    long = F.raise_error(F.concat(F.lit("more tokens than the width: "), F.col(text)))
    return df.withColumn(out, F.when(F.size(found) <= width, padded).when(F.col(text).isNotNull(), long))


def decode_tokens(column: Column | str, codes: Sequence[str]) -> Column:
    """The text of codes; padding goes."""
    names = F.array(*map(F.lit, codes))
    return F.array_join(F.transform(F.filter(column, lambda c: c != 0), lambda c: F.get(names, c)), "")


def document_tokens(text: Column | str, chars: str = "alpha", keep: str | None = None, stop_words: Sequence[str] = STOP_WORDS, stem: bool = False) -> Column:
    """Lower-cased words without stop words. chars: alpha, alnum or ascii words only; keep: a pattern that words must match.

    stem cuts the plainest English endings in the JVM; a dictionary lemmatiser is a provider's matter (operators.features).
    """
    c = F.col(text) if isinstance(text, str) else text
    shape = {"alpha": r"^\p{L}+$", "alnum": r"^[\p{L}\p{N}]+$", "ascii": r"^[\x21-\x7e]+$"}[chars]
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"), F.lit(1))
    # a constant list of many words is one hash lookup
    out = F.filter(words, lambda w: ~w.isin(*stop_words) & w.rlike(shape))
    if keep is not None:
        out = F.filter(out, lambda w: w.rlike(keep))
    if stem:
        out = F.transform(out, lambda w: F.regexp_replace(w, r"(?<=\w{3})(ing|edly|ed|ly|es|s)$", ""))
    return out


def keywords(text: Column | str, **options) -> Column:
    return F.array_sort(F.array_distinct(document_tokens(text, **options)))


def document_frequencies(df: DataFrame, id_col: str, words: str, no_below: int = 3, no_above: float = 0.7) -> DataFrame:
    """(word, df) of words in at least no_below documents and at most the share no_above of all."""
    total = df.agg(F.count("*").alias("_n"))
    counts = df.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("_n"))).select("word", "df")


def topics(df: DataFrame, words: str, num_topics: int = 64, no_below: int = 3, no_above: float = 0.7, vocabulary: int = 50_000, rounds: int = 20, seed: int = 42) -> DataFrame:
    """df with Topic, the most likely topic of a latent Dirichlet allocation over words in the document-frequency range."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    counted = CountVectorizer(inputCol=words, outputCol="_counts", minDF=float(no_below), maxDF=no_above, vocabSize=vocabulary).fit(df).transform(df)
    model = LDA(k=num_topics, maxIter=rounds, seed=seed, featuresCol="_counts").fit(counted)
    shares = vector_to_array(F.col("topicDistribution"))
    return model.transform(counted).withColumn("Topic", (F.array_position(shares, F.array_max(shares)) - 1).cast("int")).drop("_counts", "topicDistribution")


#: Distinct topic words, and pairs of a topic's words, that topic_coherence() takes; each task holds them, and a count a pair.
MOST_TOPIC_WORDS, MOST_TOPIC_PAIRS = 100_000, 1_000_000
#: Words of texts that are looked at together; a longer text is looked at whole.
SLICE_WORDS = 1 << 18


def article_fields(xml: Column | str, paths: dict[str, str]) -> list[Column]:
    """One text column for each XPath."""
    c = F.col(xml) if isinstance(xml, str) else xml
    return [F.nullif(F.xpath_string(c, F.lit(p)), F.lit("")).alias(name) for name, p in paths.items()]


def topic_coherence(df: DataFrame, id_col: str, words: str, topics: DataFrame, topic: str = "topic", word: str = "word", window: int = 110) -> DataFrame:
    """(topic, coherence): how often the words of each topic stand near each other, from windows of so many consecutive words.

    p is the share of all windows (one for each start, one for a shorter text) that hold a word, or two of them; the normalised
    pointwise mutual information of two words is ln(p(a, b) / p(a) p(b)) / -ln p(a, b), with 10^-12 added to p(a, b). A word's vector
    has this for each word of its topic, itself included, and the coherence is the mean cosine of the words' vectors and their sum.
    Windows are counted from the places of topic words, not made: those that hold a or b are a union of ranges of starts.
    Each task adds up the counts of its own texts, so no place is shuffled, and a text is read once. A topic word that no text
    holds has the vector of all zeros, and cosine 0. Ids are unique; null texts have no windows; more topic words than
    MOST_TOPIC_WORDS, or pairs of them than MOST_TOPIC_PAIRS, are an error.
    """
    wanted = topics.select(F.col(topic).alias("t"), F.col(word).alias("w")).where("w IS NOT NULL").distinct()
    wanted = settle(wanted)
    vocabulary = [r["w"] for r in wanted.select("w").distinct().orderBy("w").limit(MOST_TOPIC_WORDS + 1).collect()]
    if len(vocabulary) > MOST_TOPIC_WORDS:
        raise ValueError(f"more than {MOST_TOPIC_WORDS} distinct topic words")
    code = {w: i for i, w in enumerate(vocabulary)}
    numbers = df.sparkSession.createDataFrame(list(code.items()), "w string, c int")
    coded = wanted.join(F.broadcast(numbers), "w").select("t", "c")
    pairs = coded.withColumnRenamed("c", "a").join(coded.withColumnRenamed("c", "b"), "t").where("a <= b").select("a", "b").distinct()
    together = sorted(tuple(r) for r in pairs.limit(MOST_TOPIC_PAIRS + 1).collect())
    if len(together) > MOST_TOPIC_PAIRS:
        raise ValueError(f"more than {MOST_TOPIC_PAIRS} pairs of topic words")
    counted = _either(vocabulary, np.array(together, dtype=np.int64).reshape(-1, 2), window)
    parts = df.select(F.col(words).alias("ws")).mapInArrow(counted, "a int, b int, n long")
    sums = settle(parts.groupBy("a", "b").agg(F.sum("n").cast("double").alias("n")))
    name = F.broadcast(numbers)
    total = sums.where("a < 0").select(F.col("n").alias("total"))
    named = sums.where("a >= 0").join(name.select(F.col("c").alias("a"), F.col("w").alias("wa")), "a").join(name.select(F.col("c").alias("b"), F.col("w").alias("wb")), "b")
    either = named.select(F.col("wa").alias("a"), F.col("wb").alias("b"), F.col("n").alias("either"))
    alone = either.where("a = b").select(F.col("a").alias("w"), F.col("either").alias("own"))
    own = lambda c, name: alone.select(F.col("w").alias(c), F.col("own").alias(name))
    met = either.join(own("a", "na"), "a").join(own("b", "nb"), "b").crossJoin(F.broadcast(total))  # one row
    both = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb") - F.col("either")) / F.col("total") + F.lit(1e-12)
    score = F.when(both >= 1, F.lit(1.0)).otherwise(F.ln(both / (F.col("na") / F.col("total") * F.col("nb") / F.col("total"))) / -F.ln(both))
    known = met.select("a", "b", score.alias("s"))
    known = known.unionByName(known.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    cells = wanted.withColumnRenamed("w", "a").join(wanted.withColumnRenamed("w", "b"), "t").join(known, ["a", "b"], "left").select("t", "a", "b", F.coalesce("s", F.lit(0.0)).alias("s"))
    sums = cells.groupBy("t", "b").agg(F.sum("s").alias("z"))
    dots = cells.join(sums, ["t", "b"]).groupBy("t", "a").agg(F.sum(F.col("s") * F.col("z")).alias("dot"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    length = sums.groupBy("t").agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("ss")) * F.sqrt(F.col("zz"))), F.lit(0.0))
    return dots.join(length, "t").groupBy(F.col("t").alias(topic)).agg(F.avg(cosine).alias("coherence"))


def _either(vocabulary: Sequence[str], pairs: np.ndarray, window: int):
    """(a, b, n): over a task's texts, how many windows hold one of the words numbered a and b, for each pair of which any does; under -1, -1, all windows."""
    ends = np.concatenate([np.stack([pairs[:, k], np.arange(len(pairs))], axis=1) for k in (0, 1)])
    ends = np.unique(ends, axis=0)  # each word's pairs, one behind the other
    many = np.bincount(ends[:, 0], minlength=len(vocabulary))
    begin, kind = np.cumsum(many) - many, np.int16 if len(pairs) < 1 << 15 else np.int64
    of_word = ends[:, 1].astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, out = 0, np.zeros(len(pairs), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            offsets, known = lists.offsets.to_numpy().astype(np.int64), pa.array(vocabulary, lists.values.type)
            i = 0
            while i < len(lists):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_WORDS, "right")) - 1)
                base = offsets[i : j + 1] - offsets[i]
                n = np.where(np.diff(base) > 0, np.maximum(1, np.diff(base) - window + 1), 0)  # windows of each text
                total += int(n.sum())
                code = pc.fill_null(pc.index_in(lists.values.slice(offsets[i], base[-1]), known), -1).to_numpy()
                at = np.flatnonzero(code >= 0)
                code, doc = code[at], np.searchsorted(base, at, "right") - 1
                place = at - base[doc]
                # a place counts for each of its word's pairs; pairs are sorted, and within a pair places stay in order
                times = many[code]
                of = np.repeat(np.arange(len(at)), times)
                pair = of_word[np.arange(len(of)) + np.repeat(begin[code] - (np.cumsum(times) - times), times)]
                order = np.argsort(pair, kind="stable")
                pair, of = pair[order], of[order]
                lo, hi, d = np.maximum(0, place - window + 1)[of], np.minimum(place, n[doc] - 1)[of], doc[of]
                # starts are sorted, and so are ends: a range adds what lies behind the end of the one before
                before = np.r_[-1, hi[:-1]] if len(hi) else hi
                if len(hi):
                    before[1:][(pair[1:] != pair[:-1]) | (d[1:] != d[:-1])] = -1
                new = np.maximum(0, hi - np.maximum(lo, before + 1) + 1)
                out += np.bincount(pair, weights=new, minlength=len(pairs)).astype(np.int64)
                i = j
        met = np.flatnonzero(out)
        a, b, n = np.r_[-1, pairs[met, 0]], np.r_[-1, pairs[met, 1]], np.r_[total, out[met]]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run
