"""Tables to files. The engine's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import optional


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges in order of src and dst, by ranges of src, so that a look-up reads few row groups."""
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(table: DataFrame, path: str, key: str | None = None, rows_per_file: int | None = None) -> None:
    """A Parquet table, sorted by a key that is looked up, in files of at most so many rows."""
    out = table.repartitionByRange(key).sortWithinPartitions(key) if key else table
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def save_table(table: DataFrame, name: str, path: str) -> None:
    """A named table of the session's catalogue, its files at a path of their own."""
    table.write.mode("overwrite").option("path", path).saveAsTable(name)


def write_json(table: DataFrame, path: str, *parts: str, mode: str = "overwrite") -> None:
    """JSON lines, in a folder for each value of the parts."""
    writer = table.write.mode(mode)
    (writer.partitionBy(*parts) if parts else writer).json(path)


def append_new(rows: DataFrame, path: str, *key: str, order: str | None = None) -> None:
    """Append the rows whose key isn't stored yet; of equal ones the first by `order`, or as the rows come."""
    rest = [c for c in rows.columns if c not in key]
    at = F.col(order) if order else F.monotonically_increasing_id()
    first = rows.withColumn("__at", at).groupBy(*key).agg(F.min_by(F.struct(*rest) if rest else F.lit(True), "__at").alias("__first"))
    once = first.select(*[F.col(c) if c in key else F.col("__first")[c].alias(c) for c in rows.columns])
    stored = optional(rows.sparkSession, path) if not path.endswith(".json") else None
    if path.endswith(".json"):
        try:
            stored = rows.sparkSession.read.schema(rows.schema).json(path)
            stored.take(1)
        except Exception as e:  # the folder isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
    if stored is not None:
        once = once.join(stored.select(*key), list(key), "left_anti")
    (once.write.mode("append").json(path) if path.endswith(".json") else once.write.mode("append").parquet(path))


def score_lines(graded: DataFrame) -> DataFrame:
    """The rows of a score log: C is correct; sure unless it says otherwise."""
    return graded.select("sample_id", "target", "answer", (F.col("grade") == "C").alias("is_correct"), F.coalesce("is_sure", F.lit(True)).alias("is_sure"))
