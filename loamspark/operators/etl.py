"""Corpus tables from raw papers: papers, references, edges, texts, sections, chunks and statistics."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_spans, joined, labelled, norm_doi
from ..functions.vectors import placeholder

WINDOW, OVERLAP, MIN_CHARS = 1600, 200, 100


def papers(raw: DataFrame) -> DataFrame:
    """A row for each paper: its first usable identifier, lengths and what it has."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return raw.select(
        "corpus_id",
        "parsed_title",
        "classification",
        "year",
        "venue",
        "citationcount",
        F.coalesce(norm_doi("doi"), norm_doi("parsed_doi"), norm_doi("metadata_doi")).alias("norm_doi"),
        F.length("text").cast("long").alias("text_chars"),
        (F.length("text") / F.lit(4.0)).alias("text_tokens_est"),
        has("parsed_title").alias("has_title"),
        has("abstract").alias("has_abstract"),
        has("summary").alias("has_summary"),
        F.coalesce(F.size("sections") > 0, F.lit(False)).alias("has_sections"),
    )


def papers_meta(papers_: DataFrame) -> DataFrame:
    return papers_.select("corpus_id", "norm_doi", "year", "venue", "citationcount", "classification", "has_title", "has_abstract", "has_summary", "has_sections", "text_tokens_est")


def canonical_ids(papers_: DataFrame) -> DataFrame:
    """norm_doi and the least corpus_id that has it."""
    return papers_.filter("norm_doi is not null").groupBy("norm_doi").agg(F.min("corpus_id").alias("corpus_id"))


def references(raw: DataFrame) -> DataFrame:
    """src and the normalised identifier of each reference; null where there is none."""
    return raw.select(F.col("corpus_id").alias("src"), F.explode("references").alias("r")).select("src", norm_doi("r.doi").alias("norm_doi"))


def edges(raw: DataFrame, papers_: DataFrame) -> DataFrame:
    """Distinct citations src -> dst between papers of the corpus, without self-citations."""
    refs = references(raw).filter("norm_doi is not null")
    return refs.join(canonical_ids(papers_), "norm_doi").filter("src <> corpus_id").select("src", F.col("corpus_id").alias("dst")).distinct()


def papers_text(raw: DataFrame) -> DataFrame:
    """Title, abstract, summary and body; an empty body falls back to the sections' contents."""
    body = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.array_join(F.transform("sections", lambda s: s["content"]), "\n\n"))
    return raw.select("corpus_id", F.col("parsed_title").alias("title"), "abstract", "summary", body.alias("body"))


def papers_sections(raw: DataFrame) -> DataFrame:
    return raw.select("corpus_id", F.posexplode("sections").alias("section_idx", "s")).select("corpus_id", "section_idx", F.col("s.title").alias("section_title"), F.col("s.content").alias("content"))


def embedding_text(title: Column, abstract: Column, summary: Column) -> Column:
    return joined(title, abstract, summary)


def public_block(title: Column, abstract: Column, summary: Column) -> Column:
    return labelled(title=title, abstract=abstract, summary=summary)


def title_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")))


@F.pandas_udf(T.LongType())
def _blake2b(places: pd.Series) -> pd.Series:
    return places.map(lambda p: int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big", signed=True))


def chunk_id(*parts: Column) -> Column:
    """The id of a chunk's place: the signed 64-bit BLAKE2b of its parts joined by colons, so that ids join with stored ones."""
    return _blake2b(F.concat_ws(":", *[p.cast("string") for p in parts]))


def chunks(raw: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> DataFrame:
    """Sliding windows over the abstract (section -1) and each section that isn't empty."""
    texts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.col("abstract").alias("t"))), F.coalesce(F.transform("sections", lambda s, i: F.struct(i.alias("i"), s["content"].alias("t"))), F.expr("array()")))
    parts = raw.select("corpus_id", F.explode(F.filter(texts, lambda x: x["t"] != "")).alias("p"))
    spans = parts.select("corpus_id", F.col("p.i").alias("section_idx"), F.col("p.t").alias("t"), F.explode(chunk_spans(F.length("p.t"), window, overlap, min_chars)).alias("s"))
    place = [F.col("corpus_id"), F.col("section_idx"), F.col("s.char_start"), F.col("s.char_end")]
    return spans.select(
        chunk_id(*place).alias("chunk_id"),
        F.col("corpus_id").alias("paper_corpus_id"),
        "section_idx",
        "s.char_start",
        "s.char_end",
        F.substring(F.col("t"), F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start")).alias("chunk"),
    )


def length_stats(papers_: DataFrame, column: str = "text_chars") -> DataFrame:
    """Mean, exact percentiles and maximum of a column, and the share of papers that has each part."""
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    return papers_.agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.round(F.avg(column), 6).alias("mean"),
        *[F.round(F.percentile(column, q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)],
        F.max(column).alias("max"),
        *[share(c).alias(c) for c in ("has_title", "has_abstract", "has_summary", "has_sections")],
    )


def top_groups(table: DataFrame, column: str, n: int = 20) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def histogram(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def degree_stats(edges_: DataFrame) -> DataFrame:
    """Nodes, mean, exact percentiles and maximum of the out- and in-degrees."""
    sides = []
    for side, node in (("out", "src"), ("in", "dst")):
        degrees = edges_.groupBy(node).agg(F.count(F.lit(1)).alias("d"))
        sides.append(degrees.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n_nodes"), F.round(F.avg("d"), 6).alias("mean"), *[F.round(F.percentile("d", q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.max("d").alias("max")))
    return sides[0].unionByName(sides[1])


def graph_summary(raw: DataFrame, papers_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Counts of the citation graph and ratios of them, guarded against zero."""
    refs = references(raw).agg(F.count(F.lit(1)).alias("n_refs"), F.count("norm_doi").alias("n_refs_with_doi"))
    nodes = edges_.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))
    counts = papers_.agg(F.count(F.lit(1)).alias("n_papers"), F.count_distinct("norm_doi").alias("n_dois"))
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return counts.crossJoin(refs).crossJoin(nodes).withColumns({"resolved": ratio("n_edges", "n_refs_with_doi"), "coverage": ratio("n_src", "n_papers"), "doi_share": ratio("n_refs_with_doi", "n_refs")})


def stats_json(*tables: DataFrame) -> DataFrame:
    """One row of nested statistics as JSON, from tables of one row."""
    out = tables[0].select(F.struct("*").alias("t0"))
    for i, t in enumerate(tables[1:], 1):
        out = out.crossJoin(t.select(F.struct("*").alias(f"t{i}")))
    return out.select(F.to_json(F.struct(*[f"t{i}" for i in range(len(tables))])).alias("stats"))


def store_rows(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows for a typed vector store: unknown values get defaults, rows without metadata are left out."""
    typed = meta.select("corpus_id", F.coalesce("year", F.lit(0)).cast("int").alias("year"), F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("citationcount", F.lit(0)).cast("int").alias("citationcount"), F.coalesce("classification", F.lit("")).alias("classification"))
    return vectors.join(typed, "corpus_id")


def sparse_json(sparse: Column) -> Column:
    return F.to_json(placeholder(sparse))
