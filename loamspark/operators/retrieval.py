"""Search and reading over corpus tables: dense, sparse, hybrid, lexical, snippets, lines, similar papers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines, squash
from ..functions.vectors import dot, reciprocal_rank
from . import graph

BEAM = 128
#: Lists of ids up to this long go into a filter.
FEW_IDS = 1000
#: A call's answer is for a reader, so it has so many rows at most.
MOST_ROWS = 1000
POOL = 50
K1, B = 1.2, 0.75
TERM = r"[^\p{L}]+"
#: Bytes of texts whose terms are counted at once, of texts whose postings are stored as one run, and of a row group of them.
COUNT_BYTES = 1 << 19
RUN_BYTES = 32 << 20
GROUP_BYTES = 2 << 20
#: Rows of postings that are handed on at once.
BATCH_ROWS = 1 << 16


def conditions(year_min: int | None = None, year_max: int | None = None, venue: str | None = None) -> Column:
    """The given conditions joined by and; an unknown year is 0 in the store, so it passes year_max."""
    parts = [F.lit(True)]
    if year_min is not None:
        parts.append(F.col("year") >= year_min)
    if year_max is not None:
        parts.append(F.col("year") <= year_max)
    if venue:
        parts.append(F.col("venue") == venue)
    return reduce(lambda a, b: a & b, parts)


def pool_size(limit: int, masked: int = 0) -> int:
    """How many candidates each search takes: over-fetched for the mask, and within the beam."""
    return min(max(limit * 5, POOL) + masked, BEAM)


def dense_scores(store: DataFrame, query: list[float]) -> DataFrame:
    """store with `score`, the inner product of `embedding` and the query."""
    return store.withColumn("score", dot(F.col("embedding"), F.lit(query)))


def top(table: DataFrame, n: int, *tie: str) -> DataFrame:
    return table.orderBy(F.desc(F.round("score", 6)), *tie).limit(n)


def postings(texts: DataFrame, key: str, column: str = "text", runs: bool = False) -> DataFrame:
    """key, term, tf and len (of the text, in terms): a row for each term of each text.

    Terms are counted where a text is read, so none is shuffled. The texts of one key count as one; whether
    there are such keys is looked up first, and only then counts are merged. With runs, each partition
    is a sequence of runs sorted by term, of RUN_BYTES of texts or, where counts were merged, of all of it.
    """
    if texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _counted(texts, key, column, runs)
    merged = _counted(texts, key, column).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    lengths = merged.groupBy(F.col(key).alias("__key")).agg(F.sum("tf").alias("len"))
    joined = merged.join(lengths, F.col(key).eqNullSafe(F.col("__key"))).select(key, "term", "tf", "len")
    return joined.sortWithinPartitions("term", key) if runs else joined


def _counted(texts: DataFrame, key: str, column: str, runs: bool = False) -> DataFrame:
    """The same for each row by itself."""
    # the terms of query_terms with a space between
    spaced = F.trim(F.regexp_replace(F.lower(F.col(column)), TERM, " ")).alias("terms")
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
    most = RUN_BYTES if runs else COUNT_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches, most):
            terms = pc.split_pattern(block, " ")
            lens = pc.list_value_length(terms).to_numpy().astype(np.int64)
            words = terms.flatten().dictionary_encode()
            names, word, of = words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(lens)), lens)
            if runs:
                order = pc.array_sort_indices(names)  # by UTF-8 bytes, as Spark does
                place = np.empty(len(order), np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                pairs, tf = np.unique(place[word] * len(lens) + of, return_counts=True)
                names, (word, row) = names.take(order), np.divmod(pairs, len(lens))
            else:
                pairs, tf = (x.to_numpy() for x in pa.array(of * len(names) + word).value_counts().flatten())
                row, word = np.divmod(pairs, len(names))
            for a in range(0, len(pairs), BATCH_ROWS):
                w, r = word[a : a + BATCH_ROWS], row[a : a + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), names.take(pa.array(w)), pa.array(tf[a : a + BATCH_ROWS]), pa.array(lens[r])], names=schema.names)

    return texts.select(key, spaced).mapInArrow(count, schema)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of the rows that have terms, in their order; each block ends with the text that brings it to `most` bytes."""
    waiting, held = [], 0

    def joined() -> tuple[pa.Array, pa.Array]:
        return pa.concat_arrays([b.column(0) for b in waiting]), pa.concat_arrays([b.column(1) for b in waiting])

    for batch in batches:
        some = batch.filter(pc.fill_null(pc.not_equal(batch.column(1), ""), False))
        ends = np.cumsum(pc.binary_length(some.column(1)).to_numpy(), dtype=np.int64)
        a = before = 0
        while a < len(some):
            z = min(int(np.searchsorted(ends, before + most - held)) + 1, len(some))
            waiting.append(some.slice(a, z - a))
            held += int(ends[z - 1]) - before
            a, before = z, int(ends[z - 1])
            if held >= most:
                yield joined()
                waiting, held = [], 0
    if waiting:
        yield joined()


def corpus_stats(source: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One row: n_texts that have terms, and avg_len."""
    if "term" in source.columns:
        lengths = source.select(key, "len").distinct()
    else:
        lengths = source.select(F.size(query_terms(F.col(column))).alias("len")).filter("len > 0")
    return lengths.agg(F.count(F.lit(1)).alias("n_texts"), F.avg("len").alias("avg_len"))


def store_index(texts: DataFrame, key: str, path: str, column: str = "text") -> None:
    """Write postings and corpus_stats below a path.

    Each task writes the postings of the texts it reads as a file of runs sorted by term, in small row
    groups and pages, so a search reads of each run those of its terms only. Nothing is shuffled, and a run is
    sorted where its terms are counted: what a task holds doesn't grow with its split. A very common
    term is spread over the files as its texts are.
    """
    posted = postings(texts, key, column, runs=True)
    posted.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    stored = posted.sparkSession.read.parquet(f"{path}/postings")
    # the postings of a key are in one file, so before the shuffle there is a row for each key
    lengths = stored.groupBy(key).agg(F.first("len").alias("len"))
    lengths.agg(F.count(F.lit(1)).alias("n_texts"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings and their corpus_stats."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def query_terms(query: str | Column) -> Column:
    q = F.lit(query) if isinstance(query, str) else query
    return F.filter(F.split(F.lower(q), TERM), lambda t: t != "")


def terms_of(query: str) -> list[str]:
    """The terms of a query, in order, as the postings have them."""
    return "".join(c if c.isalpha() else " " for c in query.lower()).split()


def term_hits(source: DataFrame, key: str, query: str, column: str = "text") -> DataFrame:
    """key, term, tf and len of the query's terms only, from postings or from texts.

    Postings (with a column `term`) are filtered, which reaches the scan. In texts only the query's terms
    are looked for, so no other term is exploded, let alone shuffled.
    """
    terms = sorted(set(terms_of(query)))
    if "term" in source.columns:
        return source.filter(F.col("term").isin(terms))
    if not terms:
        return source.select(key, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("len")).limit(0)
    listed = source.select(key, query_terms(F.col(column)).alias("terms"))
    found = listed.select(key, F.size("terms").cast("long").alias("len"), F.explode(F.filter("terms", lambda t: t.isin(terms))).alias("term"))
    return found.groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "len")


def sparse_scores(source: DataFrame, key: str, query: str) -> DataFrame:
    """key and score: the inner product of term counts; source: postings or texts."""
    counts = Counter(terms_of(query))
    weight = F.lit(0)
    for term, n in counts.items():
        weight = F.when(F.col("term") == term, F.lit(n)).otherwise(weight)
    return term_hits(source, key, query).groupBy(key).agg(F.sum(F.col("tf") * weight).cast("double").alias("score"))


def bm25_scores(source: DataFrame, key: str, query: str, stats: DataFrame | None = None) -> DataFrame:
    """key and score: BM25 with k1 = 1.2 and b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    source: postings or texts; stats: corpus_stats, where they are stored.
    """
    hits = term_hits(source, key, query)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each of the query's terms
    corpus = corpus_stats(source, key) if stats is None else stats
    idf = F.ln(1 + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus)).groupBy(key).agg(F.sum(weight).alias("score"))


def lexical_search(source: DataFrame, key: str, query: str, limit: int = 50, stats: DataFrame | None = None) -> DataFrame:
    return top(bm25_scores(source, key, query, stats), limit, key).select(key, F.round("score", 6).alias("score"))


def ranked(hits: DataFrame, *tie: str) -> DataFrame:
    """A few hits with their 1-based rank by score."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), *tie)))


def fused(*legs: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Reciprocal rank fusion of ranked hits; each leg is a pool of at most BEAM rows."""
    both = reduce(lambda a, b: a.unionByName(b), [leg.select(key, "rank") for leg in legs])
    return both.groupBy(key).agg(F.sum(reciprocal_rank(F.col("rank"))).alias("score"))


def masked(hits: DataFrame, mask: list[int], limit: int, key: str = "corpus_id") -> DataFrame:
    """The first `limit` hits that aren't masked; the mask acts on a pool that was taken before."""
    return top(hits.filter(~F.col(key).isin(mask)) if mask else hits, limit, key)


def search_papers(store: DataFrame, dense: list[float], posted: DataFrame | None, query: str | None, limit: int = 10, mask: list[int] | None = None, **where) -> DataFrame:
    """corpus_id, year, venue, citation_count and score of the papers nearest to a query.

    store: corpus_id, year, venue, citationcount and embedding. With postings or texts (of corpus_id) and
    a query text, dense and sparse pools are fused by rank; else the score is the inner product.
    Conditions hold before either search.
    """
    mask = mask or []
    pool = pool_size(limit, len(mask))
    eligible = store.filter(conditions(**where))
    hits = top(dense_scores(eligible, dense), pool, "corpus_id")
    if posted is not None and query:
        sparse = top(sparse_scores(posted, "corpus_id", query).join(eligible.select("corpus_id"), "corpus_id", "left_semi"), pool, "corpus_id")
        hits = top(fused(ranked(hits, "corpus_id"), ranked(sparse, "corpus_id")), pool, "corpus_id")
    else:
        hits = hits.select("corpus_id", "score")
    named = masked(hits, mask, limit).join(store.select("corpus_id", "year", "venue", "citationcount"), "corpus_id")
    return named.select("corpus_id", "year", F.nullif("venue", F.lit("")).alias("venue"), F.coalesce("citationcount", F.lit(0)).alias("citation_count"), F.round("score", 6).alias("score"))


def of_ids(table: DataFrame, column: str, ids: list[int] | DataFrame) -> DataFrame:
    """The rows with one of these ids: a list of a few goes into the filter, a long one or a table (its first column) is semi-joined."""
    if isinstance(ids, list):
        if len(ids) <= FEW_IDS:
            return table.filter(F.col(column).isin(ids))
        ids = table.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())}))
    return table.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def search_snippets(chunks: DataFrame, dense: list[float], limit: int = 10, papers: list[int] | DataFrame | None = None, mask: list[int] | None = None) -> DataFrame:
    """chunk_id, paper_corpus_id, section_idx and score of the nearest chunks, of some papers or of all."""
    mask = mask or []
    within = of_ids(chunks, "paper_corpus_id", papers) if papers else chunks
    pool = top(dense_scores(within, dense), min(limit + 4 * len(mask), BEAM), "chunk_id")
    left = pool.filter(~F.col("paper_corpus_id").isin(mask)) if mask else pool
    return top(left, limit, "chunk_id").select("chunk_id", "paper_corpus_id", "section_idx", F.round("score", 6).alias("score"))


def instance_masks(instances: DataFrame, tools: DataFrame) -> DataFrame:
    """sample_id, tool and mask: the seed ids of each instance, for the tools that declare a mask, else none.

    instances: sample_id and seed_paper_ids (null: none); tools: tool and declares_mask, a few rows.
    """
    none = F.array().cast("array<bigint>")
    ids = F.coalesce(F.col("seed_paper_ids").cast("array<bigint>"), none)
    return instances.crossJoin(F.broadcast(tools)).select("sample_id", "tool", F.when(F.col("declares_mask"), ids).otherwise(none).alias("mask"))


def masked_by_instance(hits: DataFrame, masks: DataFrame, limit: int, key: str = "corpus_id") -> DataFrame:
    """The first `limit` hits of each sample and tool that its own mask leaves; hits: sample_id, tool, key and score.

    A sample without a mask loses nothing. One join for the whole batch of sessions.
    """
    left = hits.join(masks, ["sample_id", "tool"], "left").filter(~F.coalesce(F.array_contains("mask", F.col(key)), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("sample_id", "tool").orderBy(F.desc(F.round("score", 6)), key))
    return left.withColumn("rank", place).filter(F.col("rank") <= limit).select("sample_id", "tool", key, "score", "rank")


def rows_in_order(table: DataFrame, ids: list[int], key: str = "corpus_id") -> DataFrame:
    """The table's rows for a list of ids, in the list's order (`pos`); ids that aren't there are left out, repeated ones repeat."""
    wanted = table.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], f"pos int, {key} long")
    return table.join(wanted, key).orderBy("pos")


#: Evidence up to so many characters in all is looked for by one automaton a task; beyond, by a join on words.
AUTOMATON_CHARS = 50_000_000


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of the texts that contain an item's text, both with case and white space levelled.

    docs: doc_id, text; items: item_id, text. The items' size is summed first. A set that fits a task goes to
    each as an Aho-Corasick automaton, and texts are read once where they are. Beyond that, texts and items
    are joined on the longest inner word of the item, which a containing text has, and pairs are verified.
    """
    d = docs.select("doc_id", squash("text").alias("t"))
    e = items.select("item_id", squash("text").alias("e"))
    if (e.agg(F.sum(F.length("e"))).first()[0] or 0) <= AUTOMATON_CHARS:
        return _found_by_automaton(d, e.toArrow())
    return _found_by_words(d, e)


def _found_by_automaton(docs: DataFrame, items: pa.Table) -> DataFrame:
    ids, by = items.column("item_id"), {}
    for i, text in enumerate(items.column("e").to_pylist()):
        if text is not None:
            by.setdefault(text, []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast(by)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text, of in shared.value.items():
            if text:
                machine.add_word(text, of)
        machine.make_automaton()
        empty = shared.value.get("", [])
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column("t").to_pylist()):
                if text is None:
                    continue
                hits = {i for _, of in machine.iter(text) for i in of} if len(machine) else set()
                hits.update(empty)
                rows += [r] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "nth"])

    nth = docs.sparkSession.createDataFrame(pa.table({"nth": pa.array(range(len(ids)), pa.int64()), "item_id": ids})) if len(ids) else None
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "t").mapInArrow(find, "doc_id long, nth long")
    return hits.join(F.broadcast(nth), "nth").select("doc_id", "item_id") if nth is not None else hits.select("doc_id", F.col("nth").alias("item_id")).limit(0)


def _found_by_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    items = items.withColumn("w", F.split("e", " "))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = items.filter(F.size("w") > 2).select("item_id", "e", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("k"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("k"))
    near = words.join(keyed, "k").select("doc_id", "item_id", "e").distinct()
    found = near.join(docs, "doc_id").filter(F.contains("t", "e")).select("doc_id", "item_id")
    short = items.filter(F.size("w") <= 2)
    return found.union(docs.join(short, F.contains("t", "e")).select("doc_id", "item_id"))


def nearest(queries: DataFrame, store: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score and rank of each query's k nearest vectors by inner product, itself left out.

    For many queries: each partition of the store is multiplied with all queries at once and keeps
    k candidates a query, so what is shuffled doesn't grow with the product of both sides. Queries
    (query_id and embedding) are a batch that fits the driver; all vectors have the same length.
    """
    rows = queries.select("query_id", "embedding").toArrow()
    ids = np.asarray(rows.column("query_id"))
    matrix = np.array(rows.column("embedding").to_pylist(), np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            own = batch.column("id").to_numpy()
            vectors = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(len(batch), -1)
            for a in range(0, len(own), 4096):  # a bounded matrix of scores
                some = own[a : a + 4096]
                s = matrix @ vectors[a : a + 4096].T
                s[ids[:, None] == some[None, :]] = -np.inf
                r = np.round(s, 6)
                least = np.partition(r, len(some) - k, axis=1)[:, len(some) - k] if len(some) > k else np.full(len(ids), -np.inf)
                # with those that tie with the k-th
                q, o = np.nonzero((r >= least[:, None]) & np.isfinite(r))
                yield pa.RecordBatch.from_pydict({"query_id": ids[q], "id": some[o], "score": s[q, o]})

    found = store.select(F.col(key).cast("long").alias("id"), "embedding").mapInArrow(score, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(key), F.round("score", 6).alias("score"), "rank")


#: Vectors of a block that are multiplied with a block of queries at once.
BLOCK_ROWS = 8192


def nearest_all(queries: DataFrame, store: DataFrame, k: int, key: str = "vec_id", rows: int = BLOCK_ROWS) -> DataFrame:
    """The same as `nearest` for any number of queries, none of which comes to the driver.

    Both sides are cut into blocks of about `rows`, by a hash; each pair of blocks is one task's matrix
    product and leaves k candidates a query, so a side is sent as often as the other has blocks.
    """
    blocks_q, blocks_s = (max(1, -(-t.count() // rows)) for t in (queries, store))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q")).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks_q))).withColumn("sb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_s - 1).cast("long"))))
    s = store.select(F.col(key).cast("long").alias("id"), F.col("embedding").alias("s")).withColumn("sb", F.pmod(F.xxhash64("id"), F.lit(blocks_s))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_q - 1).cast("long"))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not len(left) or not len(right):
            return pa.table(none)
        matrix = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten(), np.float64).reshape(len(t), -1)
        mine, other, vectors = left.column("query_id").to_numpy(), right.column("id").to_numpy(), matrix(right, "s")
        out = []
        for a in range(0, len(mine), 1024):  # a bounded matrix of scores
            ids = mine[a : a + 1024]
            scores = matrix(left.slice(a, 1024), "q") @ vectors.T
            scores[ids[:, None] == other[None, :]] = -np.inf
            r = np.round(scores, 6)
            least = np.partition(r, len(other) - k, axis=1)[:, len(other) - k] if len(other) > k else np.full(len(ids), -np.inf)
            i, j = np.nonzero((r >= least[:, None]) & np.isfinite(r))  # with those that tie with the k-th
            out.append(pa.table({"query_id": ids[i], "id": other[j], "score": scores[i, j]}))
        return pa.concat_tables(out)

    found = q.groupBy("qb", "sb").cogroup(s.groupBy("qb", "sb")).applyInArrow(score, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(key), F.round("score", 6).alias("score"), "rank")


def read_paper(texts: DataFrame, paper: int, offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of lines of a paper's body (texts: corpus_id, body); a missing paper has no lines."""
    found = texts.filter(F.col("corpus_id") == paper).select(lines("body").alias("ls"))
    one = found.sparkSession.range(1).select(F.lit(paper).cast("long").alias("paper_id"))
    ls = F.coalesce(F.col("ls"), F.array().cast("array<string>"))
    return one.join(found, F.lit(True), "left").select("paper_id", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), F.size(ls).alias("total_lines"), F.array_join(F.slice(ls, offset + 1, limit), "\n").alias("text"))


def read_section(sections: DataFrame, paper: int, section_idx: int, offset: int = 0, limit: int = 200) -> DataFrame:
    """The same for a section (sections: corpus_id, section_idx, content)."""
    return read_paper(sections.filter(F.col("section_idx") == section_idx).withColumnRenamed("content", "body"), paper, offset, limit)


def find_in_paper(texts: DataFrame, pattern: str, context: int = 2, most: int = 20) -> DataFrame:
    """corpus_id, line_number (from 0), line and the lines around it, for lines that match, case ignored."""
    rows = texts.select("corpus_id", lines("body").alias("ls"))
    rx = "(?i)" + pattern
    hits = F.slice(F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].rlike(rx)), 1, most)
    i = F.col("h.i")
    return rows.select("corpus_id", "ls", F.explode(hits).alias("h")).select(
        "corpus_id",
        i.alias("line_number"),
        F.col("h.x").alias("line"),
        F.slice("ls", F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context))).alias("context_before"),
        F.slice("ls", i + 2, F.lit(context)).alias("context_after"),
    )


def find_similar(edges: DataFrame, store: DataFrame, paper: int, kind: str, limit: int = 10) -> DataFrame:
    """corpus_id, year, venue, citation_count and score of papers like one; an unknown paper has none.

    Graph kinds (co_citation, bibliographic_coupling) count, and tell nothing of the papers.
    """
    if kind == "semantic":
        own = store.filter(F.col("corpus_id") == paper).select(F.col("embedding").alias("q"))
        scored = store.filter(F.col("corpus_id") != paper).crossJoin(own).withColumn("score", dot(F.col("embedding"), F.col("q")))
        return top(scored, min(limit, BEAM), "corpus_id").select("corpus_id", "year", "venue", F.col("citationcount").alias("citation_count"), F.round("score", 6).alias("score"))
    of = {"co_citation": graph.co_citation, "bibliographic_coupling": graph.coupling}
    if kind not in of:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(('semantic', *of))}")
    return of[kind](edges, paper, limit).select("corpus_id", F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("venue"), F.lit(0).alias("citation_count"), F.col("n").cast("double").alias("score"))


def paper_info(texts: DataFrame, meta: DataFrame | None, sections: DataFrame | None, paper: int | None = None) -> DataFrame:
    """Title, texts and metadata of papers with their sections' titles and line counts.

    Absent tables degrade to defaults. reference_count is the number of sections whose title begins
    with "ref".
    """
    base = texts.filter(F.col("corpus_id") == paper) if paper is not None else texts
    base = base.select("corpus_id", "title", "abstract", "summary")
    if meta is not None:
        base = base.join(meta.select("corpus_id", "year", "venue", "citationcount"), "corpus_id", "left")
    else:
        base = base.withColumns({"year": F.lit(None).cast("int"), "venue": F.lit(None).cast("string"), "citationcount": F.lit(None).cast("int")})
    if sections is None:
        return base.withColumns({"n_sections": F.lit(0), "n_lines": F.lit(0), "reference_count": F.lit(0), "sections": F.array().cast("array<struct<section_idx:int,title:string,n_lines:int>>")})
    counted = sections.select("corpus_id", F.struct("section_idx", F.col("section_title").alias("title"), F.coalesce(F.size(lines("content")), F.lit(0)).alias("n_lines")).alias("s"))
    listed = counted.groupBy("corpus_id").agg(F.sort_array(F.collect_list("s")).alias("sections"))
    out = base.join(listed, "corpus_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<section_idx:int,title:string,n_lines:int>>")))
    return out.withColumns(
        {
            "n_sections": F.size("sections"),
            "n_lines": F.aggregate("sections", F.lit(0), lambda a, s: a + s["n_lines"]),
            "reference_count": F.size(F.filter("sections", lambda s: F.lower(s["title"]).startswith("ref"))),
        }
    )


class Tools:
    """The retrieval calls over a set of tables, by name."""

    NAMES = ("search_papers", "search_snippets", "read_paper", "find_in_paper", "list_references", "list_citations", "find_similar", "paper_info", "submit_answer")

    def __init__(self, **tables: DataFrame):
        t = tables.get
        self._all: dict[str, Callable] = {
            "search_papers": lambda dense, query=None, **k: search_papers(t("store"), dense, t("postings"), query, **k),
            "search_snippets": lambda dense, **k: search_snippets(t("chunks"), dense, **k),
            "read_paper": lambda paper, section_idx=None, **k: read_paper(t("texts"), paper, **k) if section_idx is None else read_section(t("sections"), paper, section_idx, **k),
            "find_in_paper": lambda paper, pattern, **k: find_in_paper(t("texts").filter(F.col("corpus_id") == paper), pattern, **k),
            "list_references": lambda paper, limit=None: graph.references_of(t("edges"), paper, limit),
            "list_citations": lambda paper, limit=20: graph.citations_of(t("edges"), paper, limit),
            "find_similar": lambda paper, kind, limit=10: find_similar(t("edges"), t("store"), paper, kind, limit),
            "paper_info": lambda paper: paper_info(t("texts"), t("meta"), t("sections"), paper),
            "submit_answer": lambda answer: {"answer": answer, "terminal": True},
        }

    def subset(self, names: list[str] | None = None) -> dict[str, Callable]:
        names = list(self.NAMES) if names is None else names
        missing = [n for n in names if n not in self._all]
        if missing:
            raise KeyError(f"unknown tools: {', '.join(missing)}")
        return {n: self._all[n] for n in names}

    def call(self, name: str, **arguments) -> dict:
        """A tool's rows (at most MOST_ROWS), or the error's text. Never raises: the plan is run here, so its errors are caught too."""
        try:
            result = self.subset([name])[name](**arguments)
            if isinstance(result, DataFrame):
                result = [row.asDict(recursive=True) for row in result.limit(MOST_ROWS).collect()]
            return {"result": result}
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}


#: For each call what a backend that has only search by relevance, snippets, papers and citations answers it with.
ROUTES = {
    "search_papers": ("search_papers_by_relevance", {"query": "keyword", "limit": "limit"}),
    "search_snippets": ("snippet_search", {"query": "query", "limit": "limit", "paper_ids": "paper_ids"}),
    "paper_info": ("get_paper", {"paper_id": "paper_id"}),
    "list_references": ("get_citations", {"paper_id": "paper_id", "limit": "limit"}),
    "list_citations": ("get_citations", {"paper_id": "paper_id", "limit": "limit"}),
}
#: Calls that such a backend answers only in part.
LOOSE_ROUTES = {
    "find_similar": ("get_citations", {"paper_id": "paper_id", "limit": "limit"}),
    "read_paper": ("snippet_search", {"question": "query", "paper_id": "paper_ids", "limit": "limit"}),
    "find_in_paper": ("snippet_search", {"pattern": "query", "paper_id": "paper_ids", "max_hits": "limit"}),
}


def routed(name: str, arguments: dict, mode: str = "strict") -> tuple[str, dict]:
    """A call as the backend's call; those that aren't given or null are left out."""
    if mode not in ("strict", "body_revive"):
        raise ValueError(f"unknown mode {mode!r}")
    routes = ROUTES | (LOOSE_ROUTES if mode == "body_revive" else {})
    if name not in routes:
        raise KeyError(name)
    tool, names = routes[name]
    out = {there: arguments[here] for here, there in names.items() if arguments.get(here) is not None}
    if "paper_ids" in out and not isinstance(out["paper_ids"], list):
        out["paper_ids"] = [out["paper_ids"]]
    return tool, out
