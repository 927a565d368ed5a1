import pytest

from loamspark.operators import synthesis

SINGLE = "question string, answer string, evidence string, anchor string, answer_type string, title string, body string, public string, cited_label string, cited array<struct<corpus_id:long,title:string>>"
BODY = "Intro. We find that the Model reaches a score of ninety points. End."
GOOD = dict(question="what score is reached", answer="ninety", evidence="we find that  the model reaches a score of ninety points", anchor="paraphrastic", answer_type="value", title="Deep Nets", body=BODY, public="Title: Deep Nets", cited_label=None, cited=[(5, "Attention networks")])


@pytest.mark.parametrize(
    "change, valid",
    [
        ({}, True),
        ({"evidence": "something that is not in there at all"}, False),
        ({"evidence": "ninety points."}, False),  # not prose
        ({"question": "what does DEEP  nets reach"}, False),
        ({"question": "what does deep nets reach", "anchor": "named"}, True),
        ({"answer": " "}, False),
        ({"answer": "word " * 16}, False),
        ({"anchor": "full_span", "cited_label": "C1", "question": "what attention is paid"}, True),
        ({"anchor": "full_span", "cited_label": "C2", "question": "what attention is paid"}, False),
        ({"anchor": "full_span", "cited_label": "C1"}, False),  # no cue of the cited title
        ({"anchor": "full_span"}, False),
        ({"answer_type": "abstract", "evidence": "deep nets", "answer": "nets"}, True),
        ({"answer_type": "identity", "answer": "Deep Nets"}, True),
        ({"answer_type": "identity", "answer": "score"}, False),  # it is in the question
        ({"answer_type": "other"}, False),
    ],
)
def test_grounded_single(spark, change, valid):
    row = synthesis.grounded_single(spark.createDataFrame([tuple((GOOD | change).values())], SINGLE)).first()
    assert row.valid is valid
    if change.get("anchor") == "full_span" and valid:
        assert row.cited_paper_id == 5


@pytest.mark.parametrize(
    "change, valid",
    [({}, True), ({"question": "who wrote deep nets"}, False), ({"question": "is ninety right"}, False), ({"answer_type": "abstract"}, False), ({"answer_type": "abstract", "abstract": BODY}, True), ({"body": ""}, False)],
)
def test_grounded_chain(spark, change, valid):
    of = dict(question="what is reached", answer="ninety", evidence="a score of ninety", answer_type="value", title="Deep Nets", abstract="none", body=BODY) | change
    df = spark.createDataFrame([tuple(of.values())], ", ".join(f"{k} string" for k in of))
    assert synthesis.grounded_chain(df).first().valid is valid


def test_nineteen_cells():
    assert len(synthesis.CELLS) == len(set(synthesis.CELLS)) == 19
    assert ("named", "identity") not in synthesis.CELLS and ("full_span", "identity") in synthesis.CELLS


def test_gold_sets(spark):
    rows = [("q", 1, 0, True), ("q", 2, 3, False), ("q", 3, 1, False), ("q", 4, 0, False), ("r", 5, 0, True), ("s", 6, 0, True), ("s", 7, 3, False), ("s", 8, 3, False)]
    got = {r.qa_id: [tuple(x) for x in r.relevance] for r in synthesis.gold_sets(spark.createDataFrame(rows, "qa_id string, corpus_id long, grade int, is_seed boolean"), 2, 2).collect()}
    assert got == {"q": [(1, 3), (2, 3), (3, 1)]}


def test_not_short_cut(spark):
    qa = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 1, 2)], "sample_id string, start long, terminal long")
    start = spark.createDataFrame([("a", 1, 15), ("b", 1, 1)], "sample_id string, corpus_id long, rank int")
    end = spark.createDataFrame([("a", 2, 9), ("a", 2, 4), ("b", 2, 7), ("b", 2, 3)], "sample_id string, corpus_id long, rank int")
    assert {(r.sample_id, r.keep) for r in synthesis.not_short_cut(qa, start, end).collect()} == {("a", True), ("b", False), ("c", False)}


def test_retrieval_ranks(spark):
    hits = [("a", "search_papers", 1, 5), ("a", "search_papers", 2, 9), ("a", "search_snippets", 1, 4), ("a", "search_snippets", 2, 4), ("a", "search_snippets", 3, 9), ("b", "search_papers", 1, 1)]
    df = spark.createDataFrame(hits, "sample_id string, tool string, pos int, corpus_id long")
    seeds = spark.createDataFrame([("a", 9), ("b", 9)], "sample_id string, seed long")
    assert {(r.sample_id, r.paper_rank, r.snippet_rank, r.found) for r in synthesis.retrieval_ranks(df, seeds).collect()} == {("a", 2, 2, True), ("b", None, None, False)}


def test_candidates(spark):
    members = spark.createDataFrame([(0, 5), (1, 6), (2, 1)], "ord long, corpus_id long")
    found = spark.createDataFrame([(0, 6), (1, 7), (2, 8)], "ord long, corpus_id long")
    assert [r.corpus_id for r in synthesis.candidates(members, found, 1, 3).collect()] == [5, 6, 7]


def test_filters(spark):
    df = spark.createDataFrame([("A Survey of x", "abc"), ("article", None), (None, "abcd")], "classification string, body string")
    assert synthesis.primary_research(df).count() == 2 and synthesis.with_body(df, 4).count() == 1
