import math
import random

import pytest
from pyspark.sql import functions as F

from loamspark.functions import scores
from loamspark.operators import evaluation, synthesis


def value(spark, make, **columns):
    kinds = {list: "array<long>", float: "double", int: "int", str: "string"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    return df.select(make(*[F.col(c) for c in columns]).alias("v")).first()[0]


def test_recall_and_gain(spark):
    assert value(spark, scores.recall, a=[1, 2, 3], b=[2, 9]) == 0.5
    assert value(spark, scores.recall, a=[2], b=[2, 2]) == 0.5  # the denominator counts repeats
    assert value(spark, scores.recall, a=[1], b=[]) == 0
    assert value(spark, scores.gain, a=[2, 9], b=[2, 9]) == 1
    assert value(spark, scores.gain, a=[1, 2], b=[2]) == 0.5
    assert value(spark, scores.gain, a=[2, 2], b=[2]) == 1.5  # repeats count again
    assert value(spark, scores.gain, a=[], b=[]) == 0


def rank_score(grades):
    dcg = lambda gs: sum(g / math.log(i + 2) for i, g in enumerate(gs))
    hi, lo = dcg(sorted(grades, reverse=True)), dcg(sorted(grades))
    return 0.0 if not grades else float(hi > 0) if hi == lo else (dcg(grades) - lo) / (hi - lo)


@pytest.mark.parametrize("grades", [[], [0], [3], [3, 3], [0, 0], [3, 1, 0], [0, 1, 3], [1, 3, 0, 2]])
def test_rank_score(spark, grades):
    assert value(spark, scores.rank_score, g=grades) == pytest.approx(rank_score(grades))


def test_paper_set(spark):
    predicted = spark.createDataFrame([("a", [1, 1, 2, 9]), ("b", []), ("c", [7])], "sample_id string, ids array<long>")
    gold = spark.createDataFrame([("a", 1, 3, None), ("a", 2, 1, None), ("a", 5, 3, None), ("b", 1, 3, None), ("c", 1, 1, None)], "sample_id string, corpus_id long, grade int, est int")
    got = {r.sample_id: (r.n_pred, r.total, r.recall_at_est, r["rank"], r.reward) for r in synthesis.paper_set_scores(predicted, gold).collect()}
    assert got == {"a": (3, 2, 0.5, 1.0, round(2 / 3, 6)), "b": (0, 1, 0.0, 0.0, 0.0), "c": (1, 0, 0.0, 0.0, 0.0)}


@pytest.mark.parametrize(
    "said, gold, want",
    [("$1,000", "1000", True), ("17.0", "17", True), ("x", "17", False), ("a, b", "A,b", True), ("a", "a, b", False), ("1;2.50", "1; 2.5", True), ("The Cat.", "thecat", True), ("dog", "cat", False), ("1000", "1_000", True)],
)
def test_gaia(spark, said, gold, want):
    assert value(spark, scores.gaia_correct, a=said, g=gold) is want


def test_label_shares(spark):
    row = evaluation.label_shares(spark.createDataFrame([(g,) for g in "AABC"], "grade string")).first()
    assert (row.correct, row.incorrect, row.not_attempted) == (0.5, 0.25, 0.25)
    assert row.f_score == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3), abs=1e-6)
    row = evaluation.label_shares(spark.createDataFrame([], "grade string")).first()
    assert (row.n, row.f_score, row.correct_given_attempted) == (0, 0, 0)


def test_pass_at_k(spark):
    runs = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", False)], "sample_id string, solved boolean")
    passed = evaluation.pass_at_k(runs)
    assert {(r.sample_id, r.passed, r.k) for r in passed.collect()} == {("a", 1, 3), ("b", 0, 1)}
    assert [tuple(r) for r in evaluation.band(passed, 1, 2).collect()] == [(1, 1)]


@pytest.mark.parametrize("values, q, want", [([], 0.5, 0.0), ([5.0], 0.95, 5.0), ([4.0, 1.0, 3.0, 2.0], 0.5, 3.0), ([float(i) for i in range(100)], 0.95, 95.0)])
def test_index_percentile(spark, values, q, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(evaluation.index_percentile(F.col("v"), q)).first()[0] == want


def test_no_queries_no_metrics(spark):
    assert evaluation.ranking_metrics(spark.createDataFrame([], "retrieved array<long>, relevant array<long>")).count() == 0


def test_rewards_have_fixed_columns(spark):
    schema = "sample_id string, answer_type string, answer string, verdict string, set_reward double, recall_at_est double, rank double, n_pred int, parse string"
    rows = [("a", "value", "x", "Correct", None, None, None, None, None), ("b", "value", None, "Correct", None, None, None, None, None), ("c", "paper_set", "[1]", None, 0.5, 0.4, 0.6, 2, "json")]
    out = evaluation.rewards(spark.createDataFrame(rows, schema))
    assert {(r.sample_id, r.score, r.method, r.parse) for r in out.collect()} == {("a", 1.0, "judge", None), ("b", 0.0, "no_answer", None), ("c", 0.5, "paper_set", "json")}
    row = evaluation.reward_summary(out).first()
    assert (row.n, row.mean_score, row.n_judge, row.n_paper_set, row.n_no_answer, row.parse_failures) == (3, 0.5, 1, 1, 1, 0)


def test_percentiles_of_rows_are_those_of_lists(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, round(rng.random(), 2), rng.random() * 3, 0.5])) for g in "aaabbc" * 40] + [("d", None), ("e", 1.005)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p0, r.p50, r.p95) for r in evaluation.index_percentiles(df, "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}, "g").collect()}
    for g in "abcde":
        s = sorted(v for h, v in rows if h == g and v is not None)
        want = [s[min(len(s) - 1, int(q * len(s)))] if s else 0.0 for q in (0.0, 0.5, 0.95)]
        assert all(abs(x - y) <= 0.00501 for x, y in zip(got[g], want)), g
    one = evaluation.index_percentiles(df, "v", {"p50": 0.5}).collect()
    assert len(one) == 1 and evaluation.index_percentiles(df.limit(0), "v", {"p50": 0.5}, "g").count() == 0


def test_rollout_rows(spark):
    runs = spark.createDataFrame([(1, 0, "Correct", None, 2.0), (1, 1, "Correct", "KeyError", 1.0), (1, 2, "Correct", None, 99.0), (1, 3, None, "", 3.0)], "sample_id long, rollout long, verdict string, exception string, latency double")
    got = [(r.solved, r.error, r.latency) for r in evaluation.rollout_rows(runs, 60.0).orderBy("rollout").collect()]
    assert got == [(True, None, 2.0), (False, "KeyError", 1.0), (False, "TimeoutError", 60.0), (False, None, 3.0)]


def test_metric_em_of_letters_with_long_upper_case(spark, tmp_path):
    import duckdb

    from loamspark.queries import ORACLES, QUERIES

    words = ["lichß", "ﬁn", "ᾳx", "ŉa", "über", "naïve", "", "𐐨x", "ſo", "a"]
    docs = [(6 * i + k, f"x {w} y") for i, w in enumerate(words) for k in range(6)] + [(97, "none"), (103, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["metric_em"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["metric_em"]).fetchall())
    assert (1, "lichß", True) in got
