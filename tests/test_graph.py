import pytest

from loamspark.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2), (1, 3), (4, 2), (4, 3), (4, 5), (6, 2), (2, 3), (6, 5)], "src long, dst long")


def ids(df, column):
    return [r[column] for r in df.collect()]


def test_neighbours(edges):
    assert ids(graph.references_of(edges, 4), "dst") == [2, 3, 5]
    assert ids(graph.references_of(edges, 4, 2), "dst") == [2, 3]
    assert ids(graph.citations_of(edges, 2), "src") == [1, 4, 6]
    assert ids(graph.references_of(edges, 99), "dst") == []


def test_similar_papers_leave_the_paper_out(edges):
    assert [tuple(r) for r in graph.co_citation(edges, 2).collect()] == [(3, 2), (5, 2)]
    assert [tuple(r) for r in graph.coupling(edges, 1).collect()] == [(4, 2), (2, 1), (6, 1)]


def test_seeds(edges):
    assert sorted(ids(graph.seeds_by_degree(edges, 2), "src")) == [1, 4, 6]
    assert sorted(ids(graph.seeds_by_degree(edges, 2, 2), "src")) == [1, 6]


def test_pages_of_a_shuffle_are_disjoint_and_repeatable(edges):
    pages = [ids(graph.shuffled(edges.select("dst").distinct(), "dst", 5, 2, o), "dst") for o in (0, 2)]
    assert pages[0] == ids(graph.shuffled(edges.select("dst").distinct(), "dst", 5, 2), "dst")
    assert not set(pages[0]) & set(pages[1])


def test_attach_cited(spark, edges):
    texts = spark.createDataFrame([(2, "two", "x"), (3, "three", None), (5, "", "y")], "corpus_id long, title string, abstract string")
    meta = spark.createDataFrame([(2, 9), (3, None), (5, 1)], "corpus_id long, citationcount int")
    seeds = spark.createDataFrame([(1,), (4,), (2,), (7,)], "src long")
    got = sorted((r.src, r.place, r.dst) for r in graph.attach_cited(seeds, edges, texts, meta, 2).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (4, 1, 2), (4, 2, 3)]  # unknown counts last, untitled out
    got = sorted((r.src, r.dst) for r in graph.attach_cited(seeds, edges, texts, meta, 2, need_abstract=True).collect())
    assert got == [(1, 2), (4, 2)]


def test_chains(spark):
    stored = spark.createDataFrame([(1, 2, 0), (1, 9, 1), (2, 1, 2), (2, 3, 3), (3, 4, 4), (5, 6, 5), (6, 5, 6)], "src long, dst long, ord long")
    starts = spark.createDataFrame([(1,), (5,), (8,)], "src long")
    got = {r.src: r.path for r in graph.chains(starts, stored, 4, 2).collect()}
    assert got == {1: [1, 2, 3, 4], 5: [5, 6]}
    assert {r.src for r in graph.chains(starts, stored, 3, 3).collect()} == {1}


def test_first_edges_win(spark):
    b = spark.createDataFrame([(1, 2, 5, "late"), (1, 2, 1, "early"), (1, 3, 2, "x")], "src long, dst long, ord long, e string")
    assert sorted((r.src, r.dst, r.e) for r in graph.first_edges(b, "ord").collect()) == [(1, 2, "early"), (1, 3, "x")]
    stored = spark.createDataFrame([(1, 3)], "src long, dst long")
    assert [(r.dst, r.e) for r in graph.new_edges(b, stored, "ord").collect()] == [(2, "early")]


def test_chains_grow_by_a_join_a_hop(spark):
    edges = spark.createDataFrame([(i, (i * 7 + k) % 30, k) for i in range(30) for k in (1, 2)], "src long, dst long, ord int")
    starts = edges.select("src").distinct()
    joins = [graph.chains(starts, edges, n, 1)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in (2, 3, 4, 5, 6, 9)]
    assert joins == [1, 2, 3, 4, 5, 8]
    first = {}
    for i in range(30):
        path = [i]
        while len(path) < 6:
            onward = [d for d in ((path[-1] * 7 + k) % 30 for k in (1, 2)) if d not in path]
            if not onward:
                break
            path.append(onward[0])
        first[i] = path
    assert {r.src: list(r.path) for r in graph.chains(starts, edges, 6, 1).collect()} == first
