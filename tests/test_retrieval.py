import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.operators import retrieval
from loamspark.operators.retrieval import Tools


@pytest.fixture(scope="module")
def store(spark):
    rows = [(1, 2010, "a", 5, [1.0, 0.0]), (2, 0, "", None, [0.9, 0.1]), (3, 2020, "b", 1, [0.0, 1.0]), (4, 2015, "a", 2, [0.5, 0.5])]
    return spark.createDataFrame(rows, "corpus_id long, year int, venue string, citationcount int, embedding array<double>")


@pytest.fixture(scope="module")
def posted(spark):
    return retrieval.postings(spark.createDataFrame([(1, "deep nets"), (2, "shallow pools"), (3, "deep deep pools, deep"), (4, None)], "corpus_id long, text string"), "corpus_id")


@pytest.fixture(scope="module")
def texts(spark):
    body = "zero\nAlpha one\n\ntwo alpha\nthree\nALPHA"
    return spark.createDataFrame([(1, "t1", "a", "s", body), (2, "t2", None, None, ""), (3, "t3", "", "", None)], "corpus_id long, title string, abstract string, summary string, body string")


def ids(df):
    return [r.corpus_id for r in df.collect()]


def test_dense_only(store):
    hits = retrieval.search_papers(store, [1.0, 0.0], None, None, 3).orderBy(F.desc("score"))
    assert ids(hits) == [1, 2, 4]
    assert hits.collect()[1].venue is None and hits.collect()[1].citation_count == 0


def test_hybrid_fuses_ranks(store, posted):
    hits = {r.corpus_id: r.score for r in retrieval.search_papers(store, [1.0, 0.0], posted, "deep", 4).collect()}
    # dense order 1 2 4 3, sparse order 3 1
    assert hits == {1: round(1 / 61 + 1 / 62, 6), 3: round(1 / 64 + 1 / 61, 6), 2: round(1 / 62, 6), 4: round(1 / 63, 6)}


def test_mask_and_conditions(store):
    assert sorted(ids(retrieval.search_papers(store, [1.0, 0.0], None, None, 2, mask=[1]))) == [2, 4]
    assert sorted(ids(retrieval.search_papers(store, [1.0, 0.0], None, None, year_max=2012))) == [1, 2]  # an unknown year is 0
    assert ids(retrieval.search_papers(store, [1.0, 0.0], None, None, year_min=2012, venue="a")) == [4]


def test_pool_is_bounded():
    assert [retrieval.pool_size(*a) for a in ((10,), (20,), (40,), (10, 30), (10, 500))] == [50, 100, 128, 80, 128]


def test_bm25(posted):
    got = {r.corpus_id: r.score for r in retrieval.lexical_search(posted, "corpus_id", "deep").collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 8 / 3
    want = {k: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for k, tf, n in ((1, 1, 2), (3, 3, 4))}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_nearest_is_brute_force(spark, store):
    queries = store.select(F.col("corpus_id").alias("query_id"), "embedding")
    got = [tuple(r) for r in retrieval.nearest(queries, store, 2, "corpus_id").orderBy("query_id", "rank").collect()]
    v = {r.corpus_id: r.embedding for r in store.collect()}
    want = []
    for q in sorted(v):
        best = sorted((-round(sum(a * b for a, b in zip(v[q], v[c])), 6), c) for c in v if c != q)[:2]
        want += [(q, c, -s, k + 1) for k, (s, c) in enumerate(best)]
    assert got == want


def test_snippets(spark):
    rows = [(10, 1, -1, [1.0, 0.0]), (11, 1, 0, [0.9, 0.0]), (12, 2, 0, [0.8, 0.0]), (13, 3, 1, [0.1, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_corpus_id long, section_idx int, embedding array<double>")
    find = lambda **k: [r.chunk_id for r in retrieval.search_snippets(chunks, [1.0, 0.0], 2, **k).collect()]
    assert find() == [10, 11] and find(papers=[2, 3]) == [12, 13] and find(mask=[1]) == [12, 13]


def test_read(texts):
    row = retrieval.read_paper(texts, 1, 1, 2).first()
    assert (row.total_lines, row.text) == (6, "Alpha one\n")
    for paper in (2, 3, 99):
        row = retrieval.read_paper(texts, paper).first()
        assert (row.total_lines, row.text) == (0, "")


def test_find_in_paper(texts):
    hits = retrieval.find_in_paper(texts, "alpha", 1).collect()
    assert [(h.line_number, h.context_before, h.context_after) for h in hits] == [(1, ["zero"], [""]), (3, [""], ["three"]), (5, ["three"], [])]
    assert len(retrieval.find_in_paper(texts, "alpha", 1, 2).collect()) == 2


def test_paper_info(spark, texts):
    sections = spark.createDataFrame([(1, 1, "References", "a\nb"), (1, 0, "refined", ""), (1, 2, None, None)], "corpus_id long, section_idx int, section_title string, content string")
    meta = spark.createDataFrame([(1, 2001, "v", 3)], "corpus_id long, year int, venue string, citationcount int")
    row = retrieval.paper_info(texts, meta, sections, 1).first()
    assert (row.year, row.n_sections, row.n_lines, row.reference_count) == (2001, 3, 2, 2)
    assert [s.section_idx for s in row.sections] == [0, 1, 2]
    bare = retrieval.paper_info(texts, None, None, 2).first()
    assert (bare.year, bare.n_sections, bare.sections) == (None, 0, [])
    assert retrieval.paper_info(texts, None, None, 99).count() == 0


def test_similar_kinds(spark, store):
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    assert ids(retrieval.find_similar(edges, store, 1, "semantic", 2)) == [2, 4]
    row = retrieval.find_similar(edges, store, 2, "co_citation").first()
    assert (row.corpus_id, row.year, row.citation_count, row.score) == (3, None, 0, 1.0)
    assert retrieval.find_similar(edges, store, 99, "semantic").count() == 0
    with pytest.raises(ValueError):
        retrieval.find_similar(edges, store, 1, "other")


def test_registry(store, texts):
    tools = Tools(store=store, texts=texts)
    assert set(tools.subset()) == set(Tools.NAMES) and len(Tools.NAMES) == 9
    assert list(tools.subset(["read_paper"])) == ["read_paper"]
    with pytest.raises(KeyError, match="nope"):
        tools.subset(["read_paper", "nope"])
    assert tools.call("read_paper", paper=1, limit=1)["result"][0]["text"] == "zero"
    assert "nope" in tools.call("nope")["error"] and "error" in tools.call("read_paper", wrong=1)
    assert tools.call("submit_answer", answer="x")["result"]["terminal"]


def test_routes():
    assert retrieval.routed("search_papers", {"query": "q", "limit": None}) == ("search_papers_by_relevance", {"keyword": "q"})
    with pytest.raises(KeyError):
        retrieval.routed("read_paper", {"paper_id": 3})
    assert retrieval.routed("read_paper", {"paper_id": 3, "question": "q"}, "body_revive") == ("snippet_search", {"query": "q", "paper_ids": [3]})
    with pytest.raises(ValueError):
        retrieval.routed("search_papers", {}, "other")


TEXTS = [(1, "The cat, the hat: the-cat!"), (2, "ÄTHER äther İstanbul x2y"), (3, ""), (4, None), (5, "caté cat"), (6, "12 34")]


def test_terms_of_texts_and_queries_are_the_same(spark):
    df = spark.createDataFrame([(t or "",) for _, t in TEXTS], "t string")
    assert [r[0] for r in df.select(retrieval.query_terms(F.col("t"))).collect()] == [retrieval.terms_of(t or "") for _, t in TEXTS]


@pytest.mark.parametrize("query", ["the cat", "äther THE", "x y", "nothing of it", "", "12", "cat cat the"])
def test_hits_in_texts_are_those_in_postings(spark, tmp_path, query):
    texts = spark.createDataFrame(TEXTS, "corpus_id long, text string")
    posted = retrieval.postings(texts, "corpus_id")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(retrieval.term_hits(texts, "corpus_id", query)) == rows(retrieval.term_hits(posted, "corpus_id", query))
    assert rows(retrieval.sparse_scores(texts, "corpus_id", query)) == rows(retrieval.sparse_scores(posted, "corpus_id", query))
    assert rows(retrieval.bm25_scores(texts, "corpus_id", query)) == rows(retrieval.bm25_scores(posted, "corpus_id", query))


def test_stored_index_reads_its_terms_only(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "corpus_id long, text string")
    retrieval.store_index(texts, "corpus_id", str(tmp_path / "i"))
    posted, stats = retrieval.open_index(spark, str(tmp_path / "i"))
    assert tuple(stats.first()) == (3, pytest.approx((6 + 6 + 2) / 3))  # the dotted capital I is two letters in lower case, parted by a mark
    plan = retrieval.term_hits(posted, "corpus_id", "the cat")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [cat,the])" in plan and "Exchange" not in plan
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, retrieval.postings(texts, "corpus_id").collect()))


def shuffled(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["Ab", "b.c", "é", "12", "ÄB", ""], k=rng.randint(0, 60)))) for i in range(80)] + TEXTS[2:4]
    texts = spark.createDataFrame([(f"k{i}", t) for i, (_, t) in enumerate(rows)] + [(None, "a a")], "key string, text string")
    want = []
    for r in texts.select("key", retrieval.query_terms(F.coalesce("text", F.lit(""))).alias("t")).collect():
        want += [(r.key, w, r.t.count(w), len(r.t)) for w in set(r.t)]
    for most in (1, 50, 1 << 19):
        monkeypatch.setattr(retrieval, "COUNT_BYTES", most)
        posted = retrieval.postings(texts, "key")
        assert not shuffled(posted)
        assert sorted(map(repr, map(tuple, posted.collect()))) == sorted(map(repr, want))


def test_an_index_is_stored_without_a_shuffle(spark, tmp_path):
    texts = spark.range(0, 60, 1, 3).selectExpr("id AS corpus_id", "concat('b a c', id % 7, ' x', chr(97 + int(id % 5))) AS text")
    retrieval.store_index(texts, "corpus_id", str(tmp_path / "i"))
    posted, _ = retrieval.open_index(spark, str(tmp_path / "i"))
    by_file = posted.withColumn("f", F.input_file_name()).collect()
    files = {}
    for r in by_file:
        files.setdefault(r.f, []).append(r)
    assert len(files) == 3
    for rows in files.values():  # sorted by term, and all terms of a text in one
        assert [(r.term, r.corpus_id) for r in rows] == sorted((r.term, r.corpus_id) for r in rows)
    assert not {r.corpus_id for r in by_file if r.f == min(files)} & {r.corpus_id for r in by_file if r.f != min(files)}


def test_an_index_is_stored_in_runs_without_a_sort(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    texts = spark.range(0, 90, 1, 3).selectExpr("id AS corpus_id", "CASE WHEN id % 5 = 1 THEN NULL WHEN id % 5 = 3 THEN '--' WHEN id = 40 THEN repeat('z a ', 99) ELSE concat('b É c', id % 7, ' x', chr(97 + int(id % 5))) END AS text")
    monkeypatch.setattr(retrieval, "RUN_BYTES", 40)
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 7)
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert "Sort" not in retrieval.postings(texts, "corpus_id", runs=True)._jdf.queryExecution().executedPlan().toString()
        retrieval.store_index(texts, "corpus_id", str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    posted, stats = retrieval.open_index(spark, str(tmp_path / "i"))
    files = [list(zip(*(c.to_pylist() for c in pq.read_table(f, columns=["term", "corpus_id"]).columns))) for f in (tmp_path / "i" / "postings").glob("*.parquet")]
    assert len(files) == 3
    for rows in files:
        runs = [[]]
        for i, row in enumerate(rows):
            if i and row < rows[i - 1]:
                runs.append([])
            runs[-1].append(row)
        # 18 texts of 9 bytes, five a run, over batches; the long one ends its run
        assert 3 <= len(runs) <= 5
        met = [{k for _, k in run} for run in runs]
        assert sum(map(len, met)) == len(set().union(*met))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(posted) == rows(retrieval.postings(texts, "corpus_id"))
    assert rows(stats) == rows(retrieval.corpus_stats(texts, "corpus_id"))
    for q in ("b xa", "é z", "nothing"):
        assert rows(retrieval.lexical_search(posted, "corpus_id", q, stats=stats)) == rows(retrieval.lexical_search(texts, "corpus_id", q))


def test_texts_of_one_key_count_as_one(spark, tmp_path):
    import duckdb

    from loamspark.queries import ORACLES, QUERIES

    docs = [(1, "The nation, the"), (1, "thing the"), (2, "a nation"), (2, "a nation"), (3, ""), (4, None), (5, "nation x thing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("postings", "postings_stored"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())), name
    want = {k: s for k, s in con.execute(ORACLES["bm25_stored"]).fetchall()}
    assert {r.corpus_id: r.score for r in QUERIES["bm25_stored"](spark, str(tmp_path)).collect()} == pytest.approx(want)


def test_evidence_by_automaton_by_words_and_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(["ab", "b", "Ab", "cd ", "a", "ü"], k=n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(40)] + [(90, None)]
    items = [(i, text(rng.randint(1, 4))) for i in range(25)] + [(70, ""), (71, None), (72, docs[3][1])]
    level = lambda t: " ".join(t.split()).lower()
    want = sorted((d, i) for d, t in docs for i, e in items if t is not None and e is not None and level(e) in level(t))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, -1):
        monkeypatch.setattr(retrieval, "AUTOMATON_CHARS", most)
        assert sorted(map(tuple, retrieval.containing(d, e).collect())) == want
        assert retrieval.containing(d, e.limit(0)).count() == 0 == retrieval.containing(d.limit(0), e).count()


@pytest.mark.parametrize("rows", [7, 40, 1000])
def test_nearest_of_all_by_blocks(spark, rows):
    rng = np.random.default_rng(2)
    v = np.round(rng.standard_normal((90, 5)), 1)  # with ties
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, retrieval.nearest_all(df.withColumnRenamed("vec_id", "query_id"), df, 4, rows=rows).collect()))
    want = []
    for i in range(90):
        best = sorted(((-round(float(v[i] @ v[j]), 6), j) for j in range(90) if j != i))[:4]
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(best)]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]


def test_errors_of_the_action_are_caught_too(spark):
    wrong = spark.range(1).selectExpr("id AS corpus_id", "raise_error('late') AS body")
    assert "late" in retrieval.Tools(texts=wrong.withColumn("body", F.col("body").cast("string"))).call("read_paper", paper=0)["error"]


def test_rows_in_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "corpus_id long, x string")
    assert [r.x for r in retrieval.rows_in_order(df, [2, 9, 1, 2]).collect()] == ["b", "a", "b"]
