"""Round trips: tables written to the shared folder by the sinks and read back by the sources."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import etl
from ..sources import readers, shared, sinks
from .fixtures import EDGES, part_edges, table
from .registry import query


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def read_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet files of two schemas, merged by name."""
    path, docs = shared.folder(spark, "merged"), table(spark, sf, "documents")
    docs.filter("doc_id % 2 = 0").select("doc_id", "lang").write.parquet(f"{path}/a")
    docs.filter("doc_id % 2 = 1").select("source", "doc_id").write.parquet(f"{path}/b")
    return readers.corpus(spark, f"{path}/*").select("doc_id", "lang", "source")


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def edges_stored(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.folder(spark, "edges")
    sinks.write_edges(part_edges(spark, sf), path)
    return readers.edge_table(spark, path)


@query("SELECT doc_id, lang, 0 AS missing FROM documents")
def table_stored(spark: SparkSession, sf: str) -> DataFrame:
    """In files of bounded rows sorted by key; an absent table is none."""
    path = shared.folder(spark, "table")
    sinks.write_table(table(spark, sf, "documents").select("doc_id", "lang"), f"{path}/there", "doc_id", rows_per_file=500)
    missing = [readers.optional(spark, f"{path}/not"), readers.optional_table(spark, "no_such_table")]
    return readers.optional(spark, f"{path}/there").withColumn("missing", F.lit(sum(t is not None for t in missing)))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def table_named(spark: SparkSession, sf: str) -> DataFrame:
    """A table saved by name and read by it; the name is given up again."""
    path = shared.folder(spark, "named")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    sinks.save_table(table(spark, sf, "documents").select("doc_id", "source"), name, path)
    out = readers.optional_table(spark, name).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_stored(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines in a folder for each role."""
    path = shared.folder(spark, "json")
    sinks.write_json(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path, "role")
    return readers.json_lines(spark, path, "conv_id long, turn int, text string, role string").select("conv_id", F.col("turn").cast(table(spark, sf, "conversations").schema["turn"].dataType).alias("turn"), "role", "text")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id)::INT AS nth FROM documents WHERE doc_id < 200")
def json_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one file keep its order."""
    path = shared.folder(spark, "lines")
    rows = table(spark, sf, "documents").filter("doc_id < 200").select("doc_id").orderBy("doc_id").coalesce(1)
    rows.select(F.concat(F.to_json(F.struct("doc_id")), F.when(F.col("doc_id") % 5 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    read = readers.json_lines(spark, path, "doc_id long", ordered=True)
    from pyspark.sql import Window

    return read.select("doc_id", F.row_number().over(Window.orderBy("file", "line")).alias("nth"))


@query("SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> '' AND turn % 4 <> 3")
def csv_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes, commas and line ends survive; rows without a required field don't."""
    path, rows = shared.folder(spark, "csv"), table(spark, sf, "conversations")
    rows.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text")).write.options(header=True, escape='"').csv(path)
    kept = readers.csv_table(spark, path, ("text",))
    return kept.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "text")])


@query("SELECT doc_id AS id FROM labels UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def id_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids of two logs; lines that are no number count for nothing."""
    path = shared.folder(spark, "ids")
    table(spark, sf, "labels").select(F.concat_ws("", F.lit(" "), F.col("doc_id").cast("string"))).write.text(f"{path}/a")
    table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise("gone")).write.text(f"{path}/b")
    return readers.id_log(spark, f"{path}/a", f"{path}/b")


@F.pandas_udf(T.StringType())
def _enciphered(text: pd.Series, key: pd.Series) -> pd.Series:
    """What `decrypted` reads, made byte by byte."""
    out = []
    for t, k in zip(text, key):
        stream = hashlib.sha256(k.encode()).digest()
        out.append(base64.b64encode(bytes(b ^ stream[i % 32] for i, b in enumerate(t.encode()))).decode())
    return pd.Series(out, dtype=object)


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 AND text IS NOT NULL THEN left(text, 300) END AS text FROM documents")
def decrypted_column(spark: SparkSession, sf: str) -> DataFrame:
    """One in four can't be read: three of these by another key, which gives no text, or no base 64."""
    rows = table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(300)).alias("text"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("k"))
    sealed = rows.withColumn("c", F.when(F.col("text").isNotNull(), _enciphered(F.coalesce("text", F.lit("")), "k")))
    return sealed.select("doc_id", readers.decrypted(F.when(F.col("doc_id") % 4 == 3, "abc").otherwise(F.col("c")), "k").alias("text"))


@query("SELECT 3 AS num_files, true AS sized")
def manifest_of_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.folder(spark, "manifest")
    spark.range(90).repartition(2).write.parquet(f"{path}/a")
    spark.range(9).coalesce(1).write.parquet(f"{path}/b/c")
    spark.range(9).write.json(f"{path}/d")
    found = readers.manifest(spark, path)
    return found.select("num_files", ((F.col("total_bytes") > 0) & (F.col("total_gb") >= 0)).alias("sized"))


@query("""WITH b AS (SELECT l_orderkey % 50 AS src, l_partkey % 50 AS dst, l_orderkey * 10 + l_linenumber AS ord FROM lineitem), f AS (SELECT src, dst, min(ord) FILTER (ord % 2 = 0) AS one, min(ord) FILTER (ord % 2 = 1) AS other FROM b GROUP BY ALL)
SELECT src, dst, coalesce(one, other) AS ord, one IS NOT NULL AS stored_first FROM f""")
def append_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches with unlike rows of equal key: the first by order of the first batch that has it stays."""
    path = shared.folder(spark, "appended")
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey % 50 AS src", "l_partkey % 50 AS dst", "l_orderkey * 10 + l_linenumber AS ord").withColumn("stored_first", F.col("ord") % 2 == 0)
    for part in (0, 1):
        sinks.append_new(rows.filter(F.col("ord") % 2 == part), path, "src", "dst", order="ord")
    return spark.read.parquet(path)


@query("SELECT doc_id AS sample_id, quality = 1 AS is_correct, toxic = 0 AS is_sure FROM labels")
def score_log(spark: SparkSession, sf: str) -> DataFrame:
    path = shared.folder(spark, "scores")
    graded = table(spark, sf, "labels").selectExpr("doc_id AS sample_id", "'t' AS target", "'a' AS answer", "CASE quality WHEN 1 THEN 'C' ELSE 'I' END AS grade", "CASE WHEN toxic <> 0 THEN false END AS is_sure")
    sinks.write_json(sinks.score_lines(graded), path)
    return readers.json_lines(spark, path, "sample_id long, target string, answer string, is_correct boolean, is_sure boolean").select("sample_id", "is_correct", "is_sure")


@query("SELECT count(*) AS n_docs, count(DISTINCT lang) AS n_langs, (SELECT count(*) FROM labels) AS n_labels FROM documents")
def stats_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Nested statistics as one JSON record."""
    path = shared.folder(spark, "stats")
    docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("lang").alias("n_langs"))
    etl.stats_json(docs, table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n_labels"))).select(F.col("stats").alias("value")).write.text(path)
    return readers.json_lines(spark, path, "t0 struct<n_docs:long,n_langs:long>, t1 struct<n_labels:long>").select("t0.n_docs", "t0.n_langs", "t1.n_labels")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('0:answer box:', url) ELSE '' END AS box, CASE page_id % 4 WHEN 0 THEN NULL ELSE '1:a:x|2:b:y' END AS rest FROM pages""")
def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search results as one list, the answer box first."""
    pages = table(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 3 = 0 THEN url END AS box", "CASE WHEN page_id % 4 <> 0 THEN array(named_struct('title', 'a', 'snippet', 'x'), named_struct('title', 'b', 'snippet', 'y')) END AS items")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["rank"].cast("string"), x["title"], x["snippet"])), "|")
    listed = pages.select("page_id", readers.search_items(F.col("box"), F.col("items")).alias("l"))
    rest = F.filter("l", lambda x: x["rank"] > 0)
    return listed.select("page_id", shown(F.filter("l", lambda x: x["rank"] == 0)).alias("box"), F.when(F.size(rest) > 0, shown(rest)).alias("rest"))


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN '{"7":0.5}' ELSE '{"0":1.0E-9}' END AS sparse FROM embeddings""")
def sparse_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").selectExpr("vec_id", "CASE vec_id % 3 WHEN 0 THEN map(7L, CAST(0.5 AS FLOAT)) WHEN 1 THEN cast(map() AS map<bigint,float>) END AS m")
    return rows.select("vec_id", etl.sparse_json(F.col("m")).alias("sparse"))
