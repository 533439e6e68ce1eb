"""Reading and writing tables by file extension, tables settled in a shared folder, validated stores with a reject table."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.checks import require_columns

# Suffixes of whole-file compression, and the formats that may carry one.
COMPRESSIONS = ("gz", "bz2", "xz", "zip")
COMPRESSIBLE = ("csv", "tsv")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Only a local session without that setting, as in tests, gets a folder of its own; a cluster without it is an error, as
    its executors share no other folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.brindle.settled.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.brindle.settled.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a settled table that no later step reads; any other DataFrame is left alone."""
    if hasattr(df, "settled_path"):
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def extensions(path: str) -> tuple[str, str | None]:
    """(format, compression or None) from a path's suffixes."""
    parts = PurePosixPath(path).name.lower().split(".")[1:]
    if not parts:
        raise ValueError(f"{path} has no extension")
    packed = parts.pop() if parts[-1] in COMPRESSIONS else None
    if not parts:
        raise ValueError(f"{path} has no format before its compression")
    if packed and parts[-1] not in COMPRESSIBLE:
        raise ValueError(f"{parts[-1]} files cannot be compressed as a whole")
    return parts[-1], packed


def unpack(data: bytes, compression: str) -> bytes:
    if compression == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            if len(names) != 1:
                raise ValueError("the archive must hold exactly one file")
            return z.read(names[0])
    return {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}[compression](data)


def pack(data: bytes, compression: str, name: str = "data") -> bytes:
    if compression == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        return out.getvalue()
    return {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[compression](data)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """csv, tsv (also .gz, .bz2, .xz, .zip), json, parquet, orc, xlsx and sdf files.

    gz and bz2 are read by Spark itself; xz and zip files are unpacked one to a task. Pickles are refused: loading one runs
    code. Text columns are inferred only if no schema is given.
    """
    kind, packed = extensions(path)
    if kind in ("csv", "tsv"):
        given = {"header": True, "sep": "," if kind == "csv" else "\t"} | options
        reader = spark.read.options(**given)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        if packed in ("xz", "zip"):
            lines = spark.read.format("binaryFile").load(path).select("content").rdd.flatMap(lambda r: unpack(bytes(r[0]), packed).decode().splitlines())
            return reader.csv(lines)
        return reader.csv(path)
    if kind in ("parquet", "orc", "json"):
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)
    if kind == "sdf":
        return read_sdf(spark, path)
    if kind == "xlsx":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options), schema)
    if kind in ("pkl", "pickle", "joblib"):
        raise ValueError("pickled tables are refused: loading one runs code")
    raise ValueError(f"no reader for .{kind}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """csv, tsv (gz or bz2), parquet (zstd), orc and json by extension."""
    kind, packed = extensions(path)
    if kind in ("csv", "tsv"):
        if packed in ("xz", "zip"):
            raise ValueError(f"Spark does not write .{packed}")
        given = {"header": True, "sep": "," if kind == "csv" else "\t"} | ({"compression": {"gz": "gzip", "bz2": "bzip2"}[packed]} if packed else {}) | options
        df.write.mode(mode).options(**given).csv(path)
    elif kind in ("parquet", "orc"):
        df.write.mode(mode).options(**({"compression": "zstd"} | options)).format(kind).save(path)
    elif kind == "json":
        df.write.mode(mode).options(**options).json(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(name, block, properties) of each record of structure-data files: records end with $$$$, properties are '> <name>' fields.

    Lines end with LF or CRLF, as the first line of the files does.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    end = "\r\n" if head and head[0].endswith("\r") else "\n"
    records = spark.read.option("lineSep", "$$$$" + end).text(path).select(F.regexp_replace("value", r"\r\n", "\n").alias("r")).where(F.length(F.trim("r")) > 0)
    field = r"(?m)^>[^\n<]*<([^>\n]+)>[^\n]*\n"
    names = F.regexp_extract_all("r", F.lit(field), 1)
    values = F.transform(F.slice(F.split("r", field), 2, 1_000_000), lambda x: F.regexp_replace(x, r"\n+$", ""))
    return records.select(F.trim(F.substring_index("r", "\n", 1)).alias("name"), F.get(F.split("r", r"(?m)^> "), F.lit(0)).alias("block"), F.map_from_entries(F.arrays_zip(names, values)).alias("properties"))


def write_store(df: DataFrame, path: str, record_id: str, target: str, rules: Mapping[str, Column] | None = None) -> dict:
    """A sample store under path: records/ (sorted by record_id), rejects/ (record_id, reason) and metadata/, one JSON row.

    A row is rejected if its id is null or repeated, its target array is null, or differs in length from the most
    frequent length (the smallest on ties), or if one of the rules (reason -> a column true where the row is good) fails.
    """
    require_columns(df, record_id, target)
    width = df.where(F.col(target).isNotNull()).agg(F.mode(F.size(target), deterministic=True).alias("w")).first()["w"]
    repeats = df.groupBy(record_id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(record_id).alias("_r"), F.lit(True).alias("_again"))
    rows = df.join(repeats, F.col(record_id) == F.col("_r"), "left")
    reason = F.when(F.col(record_id).isNull(), "record id is null").when(F.col("_again"), "record id is repeated").when(F.col(target).isNull(), "target is null")
    reason = reason.when(F.size(target) != F.lit(width), "target length differs")
    for said, good in (rules or {}).items():
        reason = reason.when(~F.coalesce(good, F.lit(False)), said)
    judged = settle(rows.withColumn("_reason", reason).drop("_r", "_again"))
    judged.where("_reason IS NULL").drop("_reason").repartitionByRange(record_id).sortWithinPartitions(record_id).write.mode("overwrite").parquet(f"{path}/records")
    judged.where("_reason IS NOT NULL").select(record_id, F.col("_reason").alias("reason")).write.mode("overwrite").parquet(f"{path}/rejects")
    n, bad = judged.agg(F.count(F.when(F.col("_reason").isNull(), 1)), F.count("_reason")).first()
    meta = {"schema_version": 1, "records": n, "rejects": bad, "target_length": width, "columns": df.columns}
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return meta


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The records of a store whose schema version and record count hold."""
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["meta"])
    if meta["schema_version"] != 1:
        raise ValueError(f"unknown schema version {meta['schema_version']}")
    out = spark.read.parquet(f"{path}/records")
    if out.count() != meta["records"]:
        raise ValueError("the store's records do not match its metadata")
    return out


def padded_batches(df: DataFrame, tokens: str, width: int, weight: str | None = None) -> DataFrame:
    """tokens padded with 0 to width, mask (true where a token is) and weights (1 where none are given)."""
    # the length is a column of its own, so that the mask cannot see the padded tokens
    df = df.withColumn("_n", F.size(tokens))
    n = F.col("_n")
    fits = F.when(n <= width, F.concat(F.col(tokens), F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - n)))).otherwise(F.raise_error(F.lit("a sequence is longer than the batch")))
    mask = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= n)
    return df.withColumn("mask", mask).withColumn("y_wgts", F.col(weight) if weight else F.lit(1.0)).withColumn(tokens, fits).drop("_n")
