"""Mixing sources to target weights along a time-varying curriculum.

Time runs from 0 to 1 over the training run. At time t a source is asked for words at the rate

    demand(t) = target * (1 + tilt * (2 t - 1)),

its share of the run, tilted towards the end (tilt > 0) or the start. Integrated over [0, 1] this is its target, whatever the
tilt; tilts are centred so that the rates of all sources add up to the same total at every t. The words a source has been
asked for by t are D(t) = target * ((1 - tilt) t + tilt t^2). A source's documents, in a seeded order, one pass after
another, fill [0, target); the pass of a document over [c, c + taken) is placed at the t with D(t) = c + taken / 2,
and position = t * (words of the whole run). Ranges of position are the training order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import fresh, read, settle, word_count

#: A source's words are taken at most this many times.
MAX_PASSES = 3
#: The largest change of a source's rate over the run, as a share of its mean rate.
TILT = 0.5
SEED = 17
#: Documents of a source are ordered within buckets of their hash, so that no task orders a whole source.
BUCKET_ROWS = 20_000
MIN_BUCKETS = 256


def targets(sizes: DataFrame, max_passes: int = MAX_PASSES, tilt: float = TILT) -> DataFrame:
    """sizes (source, source_size), a row a source, with weight, target and tilt.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... They share the words of all; a target stops at max_passes
    times its source's size and the excess is shared by weight again. That ends at target = least(cap, level * weight) for
    the one level at which targets add up to all words, found from prefix sums over sources in the order of cap / weight.
    The windows here run over one row a source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", max_passes * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - before) / rest
    rows = rows.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    rows = rows.withColumn("target", F.least("cap", F.coalesce(F.max("level").over(every), F.lit(0.0)) * F.col("weight")))
    total = F.sum("target").over(every)
    lean = F.when(F.col("weight") == 1, -1.0).when(F.col("weight") == 3, 1.0).otherwise(0.0)
    centred = lean - F.try_divide(F.sum(lean * F.col("target")).over(every), total)
    return rows.withColumn("tilt", F.coalesce(tilt / 2 * centred, F.lit(0.0))).withColumn("total", total).select("source", "source_size", "weight", "target", "tilt", "total")


def when_asked(words: Column, target: Column, tilt: Column) -> Column:
    """The t with D(t) = words."""
    share = F.least(F.lit(1.0), F.try_divide(words, target))
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.coalesce(F.try_divide(2 * share, (1 - tilt) + root), F.lit(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_passes: int = MAX_PASSES, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, passes) for every row of docs: what the mix takes of it, and where.

    passes is an array of (pass, taken, position), one for each time the run reads the document; only the document at which a
    source's target is reached is taken in part. taken over a source add up to its target, rounded. Null and empty texts
    have size 0 and are never taken. Rows with the same id, or without one, are separate documents: their order within the
    source is by a hash of id, source and text. Sources are compared as they are, null being one of them. An empty table gives
    an empty table. Texts may be of any length: only their sizes and hashes are shuffled.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text_hash)
    slim = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_hash.alias("text_hash"), word_count(F.col(text_col)).alias("size"), key.alias("h")))
    # one row a bucket of a source: a source's order is cut into ranges of the hash
    buckets = max(MIN_BUCKETS, slim.count() // BUCKET_ROWS)
    slim = slim.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 1) / F.lit(2.0**63 / buckets)).cast("int"))
    per_bucket = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_source = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(per_source, max_passes, tilt)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    heads = heads.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b.bucket", "before", "source_size", "target", "tilt", "total")
    here = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("inside", F.coalesce(F.sum("size").over(here), F.lit(0)))
    rows = rows.alias("r").join(heads.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
    rows = rows.select("id", "r.source", "text_hash", "size", "source_size", "target", "tilt", "total", (F.col("before") + F.col("inside")).alias("start"))
    asked = F.round("target").cast("long")

    def one(k: Column) -> Column:
        began = F.col("start") + k * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), asked - began)).cast("long")
        at = when_asked(began + taken / 2, F.col("target"), F.col("tilt"))
        return F.struct(k.cast("int").alias("pass"), taken.alias("taken"), (at * F.col("total")).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), one), lambda p: p["taken"] > 0)
    return rows.select("id", "source", "text_hash", "size", "source_size", "target", passes.alias("passes"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as the run reads them: one for each pass, range-sorted by position, with docs' columns.

    A pass that takes less than half of a document's words (at most one a source) is left out unless it is the source's only
    one; any other reads the whole text. Rows are told apart by id, source and text, nulls being equal: rows that agree in all
    three are one document, read as often as all of them are, with the other columns of the one that sorts first. What is
    written keeps the order in its files' numbers and rows: placed() reads it.
    """
    found = mix(docs, id_col, text_col, source_col, **options)
    position, hashed, a, b, c = (fresh(docs.columns, x) for x in ("_position", "_hash", "_id", "_source", "_text_hash"))
    whole = F.filter("passes", lambda p: (2 * p["taken"] >= F.col("size")) | (p["taken"] == F.round("target").cast("long")))
    reads = found.select(F.col("id").alias(a), F.col("source").alias(b), F.col("text_hash").alias(c), F.explode(whole).alias("p")).select(a, b, c, F.col("p.position").alias(position))
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = found.groupBy("id", "source", "text_hash").count().where("count > 1").select(F.col("id").alias(a), F.col("source").alias(b), F.col("text_hash").alias(c))
    on = lambda side: rows[id_col].eqNullSafe(side[a]) & rows[source_col].eqNullSafe(side[b]) & (rows[hashed] == side[c])
    same = settle(same)
    if not same.isEmpty():  # copies in all three: one row stands for them
        one = rows.join(same, on(same), "left_semi").groupBy(id_col, source_col, hashed).agg(F.min(F.struct(*docs.columns)).alias("r"))
        one = one.select(*[F.col(f"r.`{x}`").alias(x) for x in docs.columns], hashed)
        rows = rows.join(same, on(same), "left_anti").unionByName(one)
    once = rows.join(reads, on(reads))
    return once.repartitionByRange(position, id_col).sortWithinPartitions(position, id_col).select(*docs.columns)


def placed(docs: DataFrame, place_col: str) -> DataFrame:
    """docs, read from Parquet files that were written in order, with a long that tells each row's place in that order.

    It is the file's number and the row's number in it; rows need not be moved. Other tables are numbered as they come.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return docs.withColumn(place_col, F.monotonically_increasing_id())
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return docs.withColumn(place_col, F.shiftleft(F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("99999999")), F.lit(0)).cast("long"), 40) + F.col("_metadata.row_index"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["taken"])
    first = F.array_min(F.transform("passes", lambda p: p["position"])).alias("position")
    each = F.transform("passes", lambda p: p["position"]).alias("positions")
    out = found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", taken.alias("taken"), first, each)
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
