"""The corpus roles that the tables of a folder play, as tables and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_COMMON = """
doc_id AS corpus_id,
split_part(text, chr(10), 1) AS parsed_title,
nullif(split_part(text, chr(10), 2), '') AS abstract,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE split_part(text, chr(10), 3) END AS summary,
source AS classification,
CAST(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1990 + doc_id % 35 END AS INT) AS year,
lang AS venue,
CAST(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id * 7 % 101 END AS INT) AS citationcount,
CASE doc_id % 4 WHEN 0 THEN concat('https://doi.org/10.1/', doc_id % 300, ' A B') WHEN 1 THEN concat('  DOI: 10.1/', doc_id % 300, 'a b') WHEN 2 THEN NULL ELSE concat('10.1/', doc_id % 300, 'ab') END AS doi,
CASE WHEN doc_id % 8 = 2 THEN concat('http://dx.doi.org/10.1/', doc_id % 300, 'AB') END AS parsed_doi,
CASE WHEN doc_id % 8 = 6 THEN '' END AS metadata_doi,
CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text"""

RAW = f"""raw AS (SELECT {_COMMON},
CASE WHEN doc_id % 10 = 0 THEN NULL ELSE list_transform(string_split(text, chr(10)), lambda x, i: {{'title': CASE i % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'Methods' ELSE 'refined' END, 'content': x}}) END AS sections,
CASE WHEN doc_id % 9 = 0 THEN NULL ELSE list_transform(range(0, doc_id % 5 + 1), lambda k: {{'doi': CASE WHEN (doc_id + k) % 6 = 0 THEN NULL ELSE concat('10.1/', (doc_id * 7 + k * 13) % 300, 'ab') END}}) END AS refs
FROM documents)"""


def raw_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw papers with nested sections and references."""
    docs = table(spark, sf, "documents")
    sections = """CASE WHEN doc_id % 10 = 0 THEN NULL ELSE transform(split(text, '\\n', -1), (x, i) -> named_struct('title', CASE (i + 1) % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'Methods' ELSE 'refined' END, 'content', x)) END AS sections"""
    refs = """CASE WHEN doc_id % 9 = 0 THEN NULL ELSE transform(sequence(0L, doc_id % 5), k -> named_struct('doi', CASE WHEN (doc_id + k) % 6 = 0 THEN NULL ELSE concat('10.1/', (doc_id * 7 + k * 13) % 300, 'ab') END)) END AS references"""
    columns = [c.strip() for c in _COMMON.strip().split(",\n")]
    return docs.selectExpr(*columns, sections, refs)


_NORM = r"nullif(lower(trim(regexp_replace(regexp_replace({0}, '^\s*(https?://(dx\.)?doi\.org/|doi:\s*)', '', 'i'), '\s+', ''))), '')"
PAPERS = f"""papers AS (SELECT corpus_id, parsed_title, classification, year, venue, citationcount,
coalesce({_NORM.format("doi")}, {_NORM.format("parsed_doi")}, {_NORM.format("metadata_doi")}) AS norm_doi,
length(text) AS text_chars, length(text) / 4.0::DOUBLE AS text_tokens_est,
coalesce(length(parsed_title) > 0, false) AS has_title, coalesce(length(abstract) > 0, false) AS has_abstract,
coalesce(length(summary) > 0, false) AS has_summary, coalesce(len(sections) > 0, false) AS has_sections FROM raw)"""
REFS = f"""r0 AS (SELECT corpus_id AS src, unnest(refs) AS r FROM raw), refs AS (SELECT src, {_NORM.format("r.doi")} AS norm_doi FROM r0)"""
CANONICAL = "canonical AS (SELECT norm_doi, min(corpus_id) AS corpus_id FROM papers WHERE norm_doi IS NOT NULL GROUP BY norm_doi)"
CITED = "cited AS (SELECT DISTINCT src, corpus_id AS dst FROM refs JOIN canonical USING (norm_doi) WHERE src <> corpus_id)"
CORPUS = f"WITH {RAW}, {PAPERS}, {REFS}, {CANONICAL}, {CITED}"
EDGES = "edges AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM part) AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % (SELECT count(*) FROM part) <> l_partkey)"
META = """meta AS (SELECT p_partkey AS corpus_id, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS title,
CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS abstract, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS citationcount FROM part)"""


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as citations among as many papers as there are parts."""
    n = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").crossJoin(n)
    return rows.select((F.col("l_orderkey") % F.col("n")).alias("src"), F.col("l_partkey").alias("dst")).filter("src <> dst").distinct()


def part_meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS corpus_id",
        "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS title",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS abstract",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS citationcount",
    )


STORE = "store AS (SELECT vec_id AS corpus_id, embedding::DOUBLE[] AS embedding, (CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1990 + vec_id % 35 END)::INT AS year, concat('v', label) AS venue, (vec_id % 101)::INT AS citationcount FROM embeddings)"


def store(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as a typed store of papers."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS corpus_id", "embedding", "CAST(CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1990 + vec_id % 35 END AS INT) AS year", "concat('v', label) AS venue", "CAST(vec_id % 101 AS INT) AS citationcount"
    )


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One vector, as a query is given."""
    return [float(x) for x in table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


QUERY = "the nation thing"
POSTED = """terms AS (SELECT doc_id AS corpus_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda t: t <> '')) AS term FROM documents),
posted AS (SELECT *, (sum(tf) OVER (PARTITION BY corpus_id))::BIGINT AS len FROM (SELECT corpus_id, term, count(*) AS tf FROM terms GROUP BY ALL))"""


def documents_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("corpus_id"), "text", F.col("text").alias("body"))
