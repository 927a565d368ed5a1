"""Queries and samples over the citation edges src -> dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyed_order

BOILERPLATE = ("index", "introduction", "editorial", "preface", "contents", "erratum")


def references_of(edges: DataFrame, paper: int, limit: int | None = None) -> DataFrame:
    out = edges.filter(F.col("src") == paper).select("dst").orderBy("dst")
    return out.limit(limit) if limit else out


def citations_of(edges: DataFrame, paper: int, limit: int | None = 20) -> DataFrame:
    out = edges.filter(F.col("dst") == paper).select("src").orderBy("src")
    return out.limit(limit) if limit else out


def co_citation(edges: DataFrame, paper: int, limit: int = 10) -> DataFrame:
    """Papers most often cited together with one, and how often."""
    citing = edges.filter(F.col("dst") == paper).select("src")
    return _counted(edges.join(citing, "src").filter(F.col("dst") != paper), "dst", limit)


def coupling(edges: DataFrame, paper: int, limit: int = 10) -> DataFrame:
    """Papers that share most references with one, and how many."""
    cited = edges.filter(F.col("src") == paper).select("dst")
    return _counted(edges.join(cited, "dst").filter(F.col("src") != paper), "src", limit)


def _counted(pairs: DataFrame, node: str, limit: int) -> DataFrame:
    return pairs.groupBy(F.col(node).alias("corpus_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "corpus_id").limit(limit)


def seeds_by_degree(edges: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """src and out-degree d of the papers with at least `least` (and at most `most`) references."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= least)
    return out.filter(F.col("d") <= most) if most else out


def shuffled(table: DataFrame, column: str, seed: int, limit: int, offset: int = 0) -> DataFrame:
    """A page of a reproducible shuffle."""
    return table.orderBy(keyed_order(seed, F.col(column)), column).offset(offset).limit(limit)


def quota_page(table: DataFrame, column: str, seed: int, size: int, page: int, quota: int) -> DataFrame:
    """A page (from 0) of the same, cut where the pages up to it come to the quota."""
    before = page * size
    return shuffled(table, column, seed, max(0, min(size, quota - before)), before)


def attach_cited(seeds: DataFrame, edges: DataFrame, texts: DataFrame, meta: DataFrame, n: int, need_abstract: bool = False) -> DataFrame:
    """For each seed (src) its `n` least cited titled references; seeds without one are left out."""
    titled = texts.filter("title is not null and title <> ''")
    if need_abstract:
        titled = titled.filter("abstract is not null and abstract <> ''")
    cited = seeds.select("src").join(edges, "src").join(titled.select(F.col("corpus_id").alias("dst"), "title"), "dst").join(meta.select(F.col("corpus_id").alias("dst"), "citationcount"), "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.asc_nulls_last("citationcount"), "dst"))
    return cited.withColumn("place", place).filter(F.col("place") <= n).select("src", "place", "dst", "title", "citationcount")


def citation_holdout(edges: DataFrame, usable: DataFrame, min_refs: int, k: int, seed: int, limit: int) -> DataFrame:
    """Queries whose gold ids are `k` drawn references of a paper with at least `min_refs` usable ones."""
    ids = usable.select("corpus_id")
    inner = edges.join(ids.withColumnRenamed("corpus_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("corpus_id", "dst"), "dst", "left_semi")
    sources = shuffled(seeds_by_degree(inner, min_refs), "src", seed, limit).select("src")
    drawn = F.row_number().over(Window.partitionBy("src").orderBy(keyed_order(seed, F.col("src") * 1_000_003 + F.col("dst")), "dst"))
    gold = inner.join(sources, "src").withColumn("nth", drawn).filter(F.col("nth") <= k)
    return gold.select(F.concat(F.lit("ch_"), F.col("src").cast("string")).alias("sample_id"), "dst", "nth")


def known_items(texts: DataFrame, seed: int, limit: int, least: int = 30) -> DataFrame:
    """Queries that are a paper's own title, for titles that tell something."""
    title = F.col("title")
    usable = texts.filter(~F.lower(title).isin(*BOILERPLATE) & (F.length(title) > least))
    return shuffled(usable, "corpus_id", seed, limit).select(F.concat(F.lit("ki_"), F.col("corpus_id").cast("string")).alias("sample_id"), title.alias("query"), F.col("corpus_id").alias("gold"))


def first_edges(bridges: DataFrame, order: str) -> DataFrame:
    """The first row of each (src, dst) by the order column."""
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy(order))
    return bridges.withColumn("nth", nth).filter("nth = 1").drop("nth")


def new_edges(bridges: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """What appending bridges to stored ones adds: the first row of each pair that isn't stored yet."""
    return first_edges(bridges, order).join(stored.select("src", "dst"), ["src", "dst"], "left_anti")


def chains(starts: DataFrame, stored: DataFrame, hops: int, least: int) -> DataFrame:
    """Paths from each start along its first stored edge to a paper not yet on the path.

    starts: src. stored: src, dst and ord, the edges' order. Returns path (at most `hops` papers) where
    it has at least `least`. A step takes one successor, so paths don't multiply; it is one join, and one
    aggregate on the start that carries the path along.
    """
    paths = starts.select("src").distinct().select("src", F.array("src").alias("path"))
    steps = stored.select(F.col("src").alias("at"), F.col("dst"), F.col("ord"))
    for _ in range(hops - 1):
        onward = paths.withColumn("at", F.element_at("path", -1)).join(steps, "at", "left")
        fresh = F.when(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")), F.struct("ord", "dst"))
        grown = onward.groupBy("src").agg(F.first("path").alias("path"), F.min(fresh).alias("next"))
        paths = grown.select("src", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next.dst"))).otherwise(F.col("path")).alias("path"))
    return paths.filter(F.size("path") >= least)


def hops_with_fallback(stored: DataFrame, other: DataFrame) -> DataFrame:
    """src, dst and ord of stored edges, and of the other source for the papers that have no stored edge."""
    return stored.select("src", "dst", "ord").union(other.join(stored.select("src").distinct(), "src", "left_anti").select("src", "dst", "ord"))
