"""What the training-data operators share: word expressions, shared tables, column names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without these characters; bytes.split() cuts at exactly the same ones.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores added until no taken column has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. It is the cluster's spark.checkpoint.dir; only a local session without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.brindle.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.brindle.checkpoint.dir", folder)
    return folder


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of results that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame, free: bool = True) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here and a lost executor loses nothing.

    Shuffle files of earlier steps are released first, so they do not add up over an operator's steps; steps that
    shuffle little leave that, which costs a garbage collection of the driver, to the next one (free=False).
    """
    spark = df.sparkSession
    if free:
        release(spark)
    path = f"{shared_folder(spark).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def settle_small(df: DataFrame) -> DataFrame:
    return settle(df, free=False)


def discard(df: DataFrame) -> None:
    """Deletes a settled table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in a column have about size bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        below = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, below + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
