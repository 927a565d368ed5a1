"""Queries that build corpus tables and their statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_doi
from ..functions.vectors import unit
from ..operators import etl, synthesis
from .fixtures import CORPUS, RAW, _NORM, documents_texts, part_edges, raw_papers, store, table
from .fixtures import EDGES, STORE
from .registry import query

_STATS = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))


@query(f"WITH {RAW} SELECT corpus_id, {_NORM.format('doi')} AS norm_doi, {_NORM.format('doi').replace(chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) * 2, chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39))} AS strict_doi FROM raw")
def norm_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return raw_papers(spark, sf).select("corpus_id", norm_doi("doi").alias("norm_doi"), norm_doi("doi", strict=True).alias("strict_doi"))


@query(f"{CORPUS} SELECT * FROM papers")
def papers_table(spark: SparkSession, sf: str) -> DataFrame:
    return etl.papers(raw_papers(spark, sf))


@query(f"{CORPUS} SELECT corpus_id, norm_doi, year, venue, citationcount, classification, has_title, has_abstract, has_summary, has_sections, text_tokens_est FROM papers")
def papers_meta(spark: SparkSession, sf: str) -> DataFrame:
    return etl.papers_meta(etl.papers(raw_papers(spark, sf)))


@query(f"{CORPUS} SELECT * FROM canonical")
def canonical_ids(spark: SparkSession, sf: str) -> DataFrame:
    return etl.canonical_ids(etl.papers(raw_papers(spark, sf)))


@query(f"{CORPUS} SELECT * FROM refs")
def references_explode(spark: SparkSession, sf: str) -> DataFrame:
    return etl.references(raw_papers(spark, sf))


@query(f"{CORPUS} SELECT * FROM cited")
def edges_build(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_papers(spark, sf)
    return etl.edges(raw, etl.papers(raw))


@query(f"""{CORPUS}, a AS (SELECT count(*) AS n_papers, count(DISTINCT norm_doi) AS n_dois FROM papers), b AS (SELECT count(*) AS n_refs, count(norm_doi) AS n_refs_with_doi FROM refs),
c AS (SELECT count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM cited)
SELECT *, round(n_edges / greatest(n_refs_with_doi, 1), 4) AS resolved, round(n_src / greatest(n_papers, 1), 4) AS coverage, round(n_refs_with_doi / greatest(n_refs, 1), 4) AS doi_share FROM a, b, c""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_papers(spark, sf)
    papers = etl.papers(raw)
    return etl.graph_summary(raw, papers, etl.edges(raw, papers))


@query(f"{CORPUS} SELECT count(*) AS n_papers, round(avg(text_chars), 6) AS mean, {_STATS.format(c='text_chars')}, max(text_chars) AS max, " + ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in ("has_title", "has_abstract", "has_summary", "has_sections")) + " FROM papers")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return etl.length_stats(etl.papers(raw_papers(spark, sf)))


@query(f"WITH {RAW} SELECT classification, count(*) AS n FROM raw GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 20")
def class_top20(spark: SparkSession, sf: str) -> DataFrame:
    return etl.top_groups(raw_papers(spark, sf), "classification")


@query(f"WITH {RAW} SELECT year, count(*) AS n FROM raw GROUP BY 1")
def year_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return etl.histogram(raw_papers(spark, sf), "year")


_SIDE = "SELECT '{0}' AS side, count(*) AS n_nodes, round(avg(d), 6) AS mean, " + _STATS.format(c="d") + ", max(d) AS max FROM (SELECT {1}, count(*) AS d FROM edges GROUP BY 1)"


@query(f"WITH {EDGES} {_SIDE.format('out', 'src')} UNION ALL {_SIDE.format('in', 'dst')}")
def edge_degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return etl.degree_stats(part_edges(spark, sf))


@query(f"WITH {RAW} SELECT corpus_id, parsed_title AS title, abstract, summary, coalesce(nullif(text, ''), array_to_string(list_transform(sections, lambda s: s.content), chr(10) || chr(10))) AS body FROM raw")
def papers_text(spark: SparkSession, sf: str) -> DataFrame:
    return etl.papers_text(raw_papers(spark, sf))


@query(f"WITH {RAW}, s AS (SELECT corpus_id, unnest(sections) AS s, generate_subscripts(sections, 1) - 1 AS i FROM raw) SELECT corpus_id, i::INT AS section_idx, s.title AS section_title, s.content FROM s")
def sections_explode(spark: SparkSession, sf: str) -> DataFrame:
    return etl.papers_sections(raw_papers(spark, sf))


@query(f"""WITH {RAW}, s AS (SELECT corpus_id, unnest(sections).content AS t, generate_subscripts(sections, 1) - 1 AS i FROM raw UNION ALL SELECT corpus_id, abstract, -1 FROM raw),
c AS (SELECT *, length(t) AS n, unnest(CASE WHEN length(t) < 20 THEN []::BIGINT[] WHEN length(t) <= 160 THEN [0]::BIGINT[] ELSE range(0, length(t) - 160 + 120, 120) END) AS a FROM s WHERE t <> '')
SELECT corpus_id AS paper_corpus_id, i::INT AS section_idx, a::INT AS char_start, least(a + 160, n)::INT AS char_end, substr(t, a + 1, least(a + 160, n) - a) AS chunk FROM c WHERE least(a + 160, n) - a >= 20""")
def chunk_slide(spark: SparkSession, sf: str) -> DataFrame:
    return etl.chunks(raw_papers(spark, sf), 160, 40, 20).drop("chunk_id")


def _place_ids() -> str:
    ids = {(d, s, a): int.from_bytes(hashlib.blake2b(f"{d}:{s}:{a}:{a + 160}".encode(), digest_size=8).digest(), "big", signed=True) for d in range(40) for s, a in ((-1, 0), (0, 120), (3, 240))}
    return ", ".join(f"({d}, {s}, {a}, {i})" for (d, s, a), i in ids.items())


@query(f"SELECT v.* FROM (VALUES {_place_ids()}) v(corpus_id, section_idx, char_start, chunk_id) JOIN documents ON doc_id = corpus_id")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of places, against BLAKE2b of the standard library."""
    places = table(spark, sf, "documents").filter("doc_id < 40").selectExpr("doc_id AS corpus_id", "inline(array(named_struct('section_idx', -1, 'char_start', 0), named_struct('section_idx', 0, 'char_start', 120), named_struct('section_idx', 3, 'char_start', 240)))")
    return places.select("corpus_id", "section_idx", "char_start", etl.chunk_id(F.col("corpus_id"), F.col("section_idx"), F.col("char_start"), F.col("char_start") + 160).alias("chunk_id"))


@query(f"""WITH {RAW} SELECT corpus_id, array_to_string(list_filter([parsed_title, abstract, summary], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS embedded,
array_to_string(list_filter([CASE WHEN parsed_title <> '' THEN 'Title: ' || parsed_title END, CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS public,
'Title: ' || coalesce(parsed_title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '') AS title_abstract FROM raw""")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    t, a, s = F.col("parsed_title"), F.col("abstract"), F.col("summary")
    return raw_papers(spark, sf).select("corpus_id", etl.embedding_text(t, a, s).alias("embedded"), etl.public_block(t, a, s).alias("public"), etl.title_abstract(t, a).alias("title_abstract"))


@query(f"WITH {RAW} SELECT vec_id AS corpus_id, coalesce(year, 0)::INT AS year, coalesce(venue, '') AS venue, coalesce(citationcount, 0)::INT AS citationcount, coalesce(classification, '') AS classification FROM embeddings JOIN raw ON vec_id * 3 = corpus_id")
def store_rows(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("corpus_id"), "vec_id")
    return etl.store_rows(vectors, raw_papers(spark, sf)).select(F.col("vec_id").alias("corpus_id"), "year", "venue", "citationcount", "classification")


@query(f"WITH {STORE}, n AS (SELECT *, greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12) AS n FROM store) SELECT corpus_id, round(list_dot_product(embedding, embedding) / n / n, 6) AS squared, round(embedding[1] / n, 6) AS head FROM n")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    u = unit(F.transform("embedding", lambda x: x.cast("double")))
    return store(spark, sf).select("corpus_id", u.alias("u")).select("corpus_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"), F.round(F.get("u", F.lit(0)), 6).alias("head"))


@query(f"WITH {RAW} SELECT corpus_id, venue FROM raw WHERE NOT regexp_matches(lower(coalesce(CASE WHEN corpus_id % 6 = 0 THEN 'A Review' WHEN corpus_id % 6 = 1 THEN NULL ELSE classification END, '')), 'review|survey|overview|meta-analysis') AND length(text) >= 500")
def seed_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_papers(spark, sf).withColumn("classification", F.expr("CASE WHEN corpus_id % 6 = 0 THEN 'A Review' WHEN corpus_id % 6 = 1 THEN NULL ELSE classification END")).withColumnRenamed("text", "body")
    return synthesis.with_body(synthesis.primary_research(raw), 500).select("corpus_id", "venue")


@query(r"""SELECT doc_id AS corpus_id, len(t) >= 6 AND len(list_filter(t, lambda x: regexp_matches(x, '\p{L}'))) >= 0.6 * len(t) AS prose FROM (SELECT doc_id, list_filter(regexp_split_to_array(split_part(text, chr(10), 2), '\s+'), lambda x: x <> '') AS t FROM documents)""")
def prose_test(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import is_prose

    return documents_texts(spark, sf).select("corpus_id", is_prose(F.split_part("text", F.lit("\n"), F.lit(2))).alias("prose"))
