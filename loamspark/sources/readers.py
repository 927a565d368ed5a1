"""Tables from files."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a path, columns merged by name. Splits are the engine's business."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("src", "dst")


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, ordered: bool = False) -> DataFrame:
    """Records of one file, or of all files of a folder; blank lines count for nothing.

    ordered: with `file` and `line` (a number that grows within a file), by which files' order is kept.
    """
    if not ordered:
        return spark.read.schema(schema).json(path)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter(F.trim("value") != "")
    return rows.select("file", "line", F.from_json("value", T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).alias("r")).select("file", "line", "r.*")


def csv_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; rows that lack a required field are left out."""
    out = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    for c in required:
        out = out.filter(F.coalesce(F.trim(c), F.lit("")) != "")
    return out


def id_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct ids of line-oriented logs; lines that aren't a number count for nothing."""
    return spark.read.text(list(paths)).select(F.trim("value").try_cast("bigint").alias("id")).filter("id is not null").distinct()


def pending(table: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose key isn't done yet."""
    return table.join(done.select(F.col("id").alias(key)), key, "left_anti")


@F.pandas_udf(T.StringType())
def decrypted(cipher: pd.Series, key: pd.Series) -> pd.Series:
    """Text that was XORed with the repeated SHA-256 of a row's key and written in base 64; null if it can't be read."""

    def one(c: str | None, k: str | None) -> str | None:
        if c is None or k is None:
            return None
        try:
            data = np.frombuffer(base64.b64decode(c), np.uint8)
            stream = np.frombuffer(hashlib.sha256(k.encode()).digest(), np.uint8)
            return (data ^ np.resize(stream, len(data))).tobytes().decode()
        except ValueError:
            return None

    return pd.Series([one(c, k) for c, k in zip(cipher, key)], dtype=object)


def manifest(spark: SparkSession, path: str, suffix: str = "*.parquet") -> DataFrame:
    """Number and bytes of the files of a folder and what lies below; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")).withColumn("total_gb", F.round(F.col("total_bytes") / float(1 << 30), 2))


def search_items(box: Column, items: Column) -> Column:
    """Search results as one list: the answer box, where there is one, with rank 0, then the items from 1 on."""
    kind = "array<struct<rank:int,title:string,snippet:string>>"
    first = F.when(box.isNotNull(), F.array(F.struct(F.lit(0).alias("rank"), F.lit("answer box").alias("title"), box.alias("snippet")))).otherwise(F.array().cast(kind))
    rest = F.transform(items, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["title"].alias("title"), x["snippet"].alias("snippet")))
    return F.concat(first.cast(kind), F.coalesce(rest.cast(kind), F.array().cast(kind)))
