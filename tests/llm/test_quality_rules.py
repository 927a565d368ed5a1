import random
from math import comb

import pytest

from loamspark.llm.quality_rules import CUTOFFS, RULES, kept, select, tail, thresholds, upper_bound, verdicts

SCHEMA = "doc_id long, text string, lang string, n_words string, stratum string"


def test_tail_against_exact_sums():
    for n, p in ((1, 0.3), (20, 0.05), (300, 0.01)):
        for k in range(0, min(n, 12)):
            assert tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_upper_bound_is_where_the_tail_is_delta():
    assert tail(3, 100, upper_bound(3, 100, 0.05)) == pytest.approx(0.05, rel=1e-6)
    assert upper_bound(0, 59, 0.05) == pytest.approx(1 - 0.05 ** (1 / 59), rel=1e-6)
    assert upper_bound(5, 5, 0.05) == 1


def test_selection_stops_at_the_first_that_fails():
    n = len(CUTOFFS)
    assert select(2000, [0] * n, [10] * n, 0.01, 0.01) == CUTOFFS[0]
    assert select(2000, [0] * 3 + [900] + [0] * (n - 4), [1, 2, 3] + [500] * (n - 3), 0.01, 0.01) == CUTOFFS[2]
    assert select(20, [0] * n, [10] * n, 0.01, 0.01) is None  # too few to tell
    assert select(2000, [1] * n, [9] * n, 0.01, 0.01) is None  # costs more than it catches


def test_guarantee_holds_on_fresh_rows():
    # with scores that don't tell good from bad, a cutoff's true rate may pass alpha once in 1 / delta
    rng = random.Random(3)
    alpha, delta, passed = 0.02, 0.1, 0
    for _ in range(200):
        good = [rng.random() ** 3 for _ in range(1500)]
        false = [sum(g > c for g in good) for c in CUTOFFS]
        c = select(1500, false, [10**6 + i for i in range(len(CUTOFFS))], alpha, delta)
        passed += c is not None and 1 - c ** (1 / 3) > alpha
    assert passed <= 0.15 * 200


def sample(spark, n=2500):
    rng = random.Random(1)
    docs, labels = [], []
    for d in range(n):
        w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)]
        bad = d % 5 == 0
        docs.append((d, " ".join(x.upper() + "!!" if bad else x for x in w), "en", None, None))
        labels.append((d, 0 if bad else 1))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_bad_go_and_clean_stay(spark):
    docs, labels = sample(spark)
    got = {r.doc_id: r for r in verdicts(docs, labels).collect()}
    assert all(got[d].keep == (d % 5 != 0) for d in got) and len(got) == 2500
    assert "shout" in got[0].failed and set(thresholds(docs, labels)["en"]) <= set(RULES)


def test_edge_cases(spark):
    docs, labels = sample(spark)
    odd = [(None, "FINE!! WORDS!!", "en", None, None), (1, None, "en", None, None), (9001, "", None, None, None), (9002, " \n", "en", None, None), (9003, "A!! B!!", None, None, None), (9004, "ABC!! " * 50_000, "en", None, None), (9004, "ABC!! " * 50_000, "en", None, None)]
    got = [(r.doc_id, r.keep) for r in verdicts(docs.union(spark.createDataFrame(odd, SCHEMA)), labels.union(spark.createDataFrame([(None, 0), (1, None), (9003, 7)], labels.schema))).collect()]
    assert (None, False) in got and (1, False) in got and (9001, False) in got and (9002, False) in got
    assert (9003, True) in got  # a stratum without labels keeps
    assert got.count((9004, False)) == 2
    left = kept(docs.union(spark.createDataFrame(odd, SCHEMA)), labels)
    assert left.columns == docs.columns and left.count() == 2001
    empty = spark.createDataFrame([], SCHEMA)
    assert verdicts(empty, labels).count() == 0 and kept(empty, labels).count() == 0
    assert verdicts(docs, labels.limit(0)).filter("keep").count() == 2500
