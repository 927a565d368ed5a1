"""Queries over the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .fixtures import EDGES, META, part_edges, part_meta, raw_papers, table
from .fixtures import RAW
from .registry import query

PAPER = 7
_SHUFFLE = "md5(({c} + {seed})::VARCHAR)"


@query(f"WITH {EDGES} SELECT dst FROM edges WHERE src = {PAPER} ORDER BY dst")
def list_references(spark: SparkSession, sf: str) -> DataFrame:
    return graph.references_of(part_edges(spark, sf), PAPER)


@query(f"WITH {EDGES} SELECT src FROM edges WHERE dst = {PAPER} ORDER BY src LIMIT 20")
def list_citations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.citations_of(part_edges(spark, sf), PAPER)


@query(f"WITH {EDGES} SELECT b.dst AS corpus_id, count(*) AS n FROM edges a JOIN edges b USING (src) WHERE a.dst = {PAPER} AND b.dst <> {PAPER} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def similar_cocitation(spark: SparkSession, sf: str) -> DataFrame:
    return graph.co_citation(part_edges(spark, sf), PAPER)


@query(f"WITH {EDGES} SELECT b.src AS corpus_id, count(*) AS n FROM edges a JOIN edges b USING (dst) WHERE a.src = {PAPER} AND b.src <> {PAPER} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def similar_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coupling(part_edges(spark, sf), PAPER)


@query(f"WITH {EDGES} SELECT src, count(*) AS d FROM edges GROUP BY 1 HAVING count(*) >= 5 ORDER BY d DESC, src LIMIT 50")
def seed_by_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.seeds_by_degree(part_edges(spark, sf), 5).orderBy(F.desc("d"), "src").limit(50)


@query(f"WITH {EDGES}, s AS (SELECT src, count(*) AS d FROM edges GROUP BY 1 HAVING count(*) BETWEEN 5 AND 40) SELECT * FROM s ORDER BY {_SHUFFLE.format(c='src', seed=42)}, src LIMIT 25 OFFSET 50")
def seed_page(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shuffled(graph.seeds_by_degree(part_edges(spark, sf), 5, 40), "src", 42, 25, 50)


def _attach(need: str) -> str:
    return f"""WITH {EDGES}, {META}, s AS (SELECT src FROM edges GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT src, dst, title, citationcount, row_number() OVER (PARTITION BY src ORDER BY citationcount NULLS LAST, dst) AS place FROM s JOIN edges USING (src) JOIN meta ON dst = corpus_id WHERE title <> ''{need})
SELECT src, place, dst, title, citationcount FROM r WHERE place <= 5"""


def _attached(spark: SparkSession, sf: str, need_abstract: bool) -> DataFrame:
    edges, meta = part_edges(spark, sf), part_meta(spark, sf)
    return graph.attach_cited(graph.seeds_by_degree(edges, 5), edges, meta, meta, 5, need_abstract)


@query(_attach(""))
def attach_cited_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf, False)


@query(_attach(" AND abstract <> ''"))
def attach_cited_abstract(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf, True)


@query(f"""WITH {EDGES}, {META}, u AS (SELECT corpus_id FROM meta WHERE title <> '' AND abstract <> ''), i AS (SELECT * FROM edges WHERE src IN (FROM u) AND dst IN (FROM u)),
s AS (SELECT src, count(*) AS d FROM i GROUP BY 1 HAVING count(*) >= 6), p AS (SELECT src FROM s ORDER BY {_SHUFFLE.format(c='src', seed=3)}, src LIMIT 40),
g AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {_SHUFFLE.format(c='src * 1000003 + dst', seed=3)}, dst) AS nth FROM i JOIN p USING (src))
SELECT concat('ch_', src) AS sample_id, dst, nth FROM g WHERE nth <= 3""")
def citation_holdout(spark: SparkSession, sf: str) -> DataFrame:
    usable = part_meta(spark, sf).filter("title <> '' and abstract <> ''")
    return graph.citation_holdout(part_edges(spark, sf), usable, 6, 3, 3, 40)


@query(f"WITH {RAW} SELECT concat('ki_', corpus_id) AS sample_id, parsed_title AS query, corpus_id AS gold FROM raw WHERE lower(parsed_title) NOT IN ({', '.join(map(repr, graph.BOILERPLATE))}) AND length(parsed_title) > 30 ORDER BY {_SHUFFLE.format(c='corpus_id', seed=9)}, corpus_id LIMIT 60")
def known_item(spark: SparkSession, sf: str) -> DataFrame:
    return graph.known_items(raw_papers(spark, sf).withColumnRenamed("parsed_title", "title"), 9, 60)


_BRIDGES = "bridges AS (SELECT l_orderkey % 50 AS src, l_partkey % 50 AS dst, l_orderkey * 10 + l_linenumber AS ord, l_shipdate FROM lineitem WHERE l_orderkey % 50 <> l_partkey % 50)"


def _bridges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey % 50 AS src", "l_partkey % 50 AS dst", "l_orderkey * 10 + l_linenumber AS ord").filter("src <> dst")


@query(f"WITH {_BRIDGES} SELECT src, dst, min(ord) AS ord FROM bridges GROUP BY 1, 2")
def bridge_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_edges(_bridges(spark, sf), "ord").groupBy("src", "dst").agg(F.min("ord").alias("ord"))


@query(f"WITH {_BRIDGES} SELECT src, dst, min(ord) AS ord FROM bridges b WHERE NOT EXISTS (SELECT 1 FROM bridges s WHERE s.src = b.src AND s.dst = b.dst AND s.src < 20) GROUP BY 1, 2")
def bridge_append(spark: SparkSession, sf: str) -> DataFrame:
    b = _bridges(spark, sf)
    return graph.new_edges(b, b.filter("src < 20").select("src", "dst").distinct(), "ord").groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def _chain_sql(hops: int, least: int) -> str:
    steps = ["c1 AS (SELECT DISTINCT src, [src] AS path FROM edges)"]
    for k in range(2, hops + 1):
        p = f"c{k - 1}"
        steps.append(f"""n{k} AS (SELECT c.src, arg_min(e.dst, e.dst) AS nxt FROM {p} c JOIN edges e ON e.src = c.path[-1] WHERE NOT list_contains(c.path, e.dst) AND len(c.path) = {k - 1} GROUP BY c.src),
c{k} AS (SELECT c.src, CASE WHEN nxt IS NULL THEN path ELSE list_append(path, nxt) END AS path FROM {p} c LEFT JOIN n{k} USING (src))""")
    return f"WITH {EDGES}, {', '.join(steps)} SELECT src, len(path) AS n_papers, array_to_string(path, '>') AS path FROM c{hops} WHERE len(path) >= {least}"


def _chained(spark: SparkSession, sf: str, hops: int, least: int) -> DataFrame:
    edges = part_edges(spark, sf)
    out = graph.chains(edges.select("src").distinct(), edges.withColumn("ord", F.col("dst")), hops, least)
    return out.select("src", F.size("path").cast("long").alias("n_papers"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(_chain_sql(3, 2))
def chain_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf, 3, 2)


@query(_chain_sql(4, 4))
def chain_three_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf, 4, 4)


@query(_chain_sql(6, 3))
def chain_five_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf, 6, 3)


@query(f"WITH {EDGES}, s AS (SELECT src, dst FROM edges WHERE src % 3 = 0) SELECT src, dst, false AS other FROM s UNION ALL SELECT dst, src, true FROM edges WHERE dst NOT IN (SELECT src FROM s)")
def hops_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Stored edges, and turned ones for the papers that have none."""
    edges = part_edges(spark, sf)
    stored = edges.filter("src % 3 = 0").withColumn("ord", F.lit(0))
    turned = edges.selectExpr("dst AS src", "src AS dst", "1 AS ord")
    return graph.hops_with_fallback(stored, turned).select("src", "dst", (F.col("ord") == 1).alias("other"))


@query(f"WITH {EDGES}, s AS (SELECT src, count(*) AS d FROM edges GROUP BY 1 HAVING count(*) BETWEEN 5 AND 40) SELECT * FROM s ORDER BY {_SHUFFLE.format(c='src', seed=42)}, src LIMIT 10 OFFSET 50")
def seed_page_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 25, of which a quota of 60 leaves 10."""
    return graph.quota_page(graph.seeds_by_degree(part_edges(spark, sf), 5, 40), "src", 42, 25, 2, 60)
