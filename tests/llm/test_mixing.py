import hashlib
import math
from collections import Counter

import pytest

from loamspark.llm import mixing as module
from loamspark.llm.mixing import SEED, copies, mixed

SCHEMA = "doc_id long, source string, n_chars long, text string, c0 string, __q string"


def rows_of(n=600):
    return [(i, f"src{i % 3}" if i % 7 else None, (i * 37) % 4000, f"t{i}", "a", "b") for i in range(n)]


def test_sizes_are_fixed_and_copies_are_the_whole_part_or_one_more(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).drop("__q")
    got = copies(df, {"src0": 4.0, "src1": 0.25}, 1.0, 1.0).collect()
    sums, of = Counter(), Counter()
    for r in got:
        sums[r.source] += r["__copies"]
        of[r.source] += r["__x"]
    weight = {"src0": 4.0, "src1": 0.25, "src2": 1.0, None: 1.0}
    for s, w in weight.items():
        assert sums[s] == int(w / 6.25 * 600 + 0.5)
    for r in got:
        mu = sums[r.source] * r["__x"] / of[r.source]
        assert int(mu) <= r["__copies"] <= int(mu) + 1


def test_sample_is_the_least_of_the_ranked_odds(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).drop("__q")
    got = copies(df, {}, 1.0, 0.3).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s and r["__q"] is not None]
        base = {r.doc_id: r["__t"] * r["__x"] // r["__sum"] for r in mine}
        took = [r["__q"] for r in mine if r["__copies"] > base[r.doc_id]]
        left = [r["__q"] for r in mine if r["__copies"] == base[r.doc_id]]
        assert not took or not left or max(took) <= min(left)


def test_inclusion_follows_size(spark):
    # over sixty draws (a source each, so that one job makes them all), a document is drawn about as often as it should be
    df = spark.createDataFrame([(k * 1000 + i, f"s{k}", 100 if i % 2 else 900, "", "", "") for k in range(60) for i in range(40)], SCHEMA).drop("__q")
    drawn, of = Counter(), Counter()
    for r in copies(df, {}, 1.0, 0.5).filter("__copies > 0").collect():
        drawn[r.n_chars] += r["__copies"]
        of[r.source] += r["__copies"]
    assert sum(drawn.values()) == 60 * 20 and set(of.values()) == {20}
    assert 2.3 < drawn[900] / drawn[100] < 4.0  # 30 to 10


def brute(rows, weights, default, fraction):
    """Copies of each row by ranking whole sources in plain Python."""
    size = {i: max(1, math.isqrt(max(r[2] or 0, 0))) for i, r in enumerate(rows)}
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[1], []).append(i)
    weight = {s: weights.get(s, default) for s in by}
    out = Counter()
    for s, mine in by.items():
        t = int(weight[s] / sum(weight.values()) * int(fraction * len(rows)) + 0.5)
        total, ranked = sum(size[i] for i in mine), []
        for i in mine:
            out[i] = t * size[i] // total
            rest = t * size[i] % total
            digits = hashlib.md5(f"{SEED}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:13]
            u = (int(digits, 16) + 0.5) / 2**52
            if rest:
                ranked.append(((u * (total - rest)) / ((1 - u) * rest), rows[i][0] is None, rows[i][0] or 0, i))
        for *_, i in sorted(ranked)[: t - sum(out[i] for i in mine)]:
            out[i] += 1
    return out


@pytest.mark.parametrize("most", [0, 100_000])
def test_against_ranking_whole_sources(spark, monkeypatch, most):
    # with each source's numbers broadcast, and joined like any table
    monkeypatch.setattr(module, "BROADCAST_SOURCES", most)
    rows = rows_of(900) + [(None, "src1", 50, "", "", ""), (2000, "src1", None, "", "", ""), (2001, None, -5, "", "", "")]
    want = brute(rows, {"src0": 4.0, "src1": 0.25}, 1.0, 0.7)
    got = copies(spark.createDataFrame(rows, SCHEMA).drop("__q"), {"src0": 4.0, "src1": 0.25}, 1.0, 0.7).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r["__copies"] for r in got} == {rows[i][0]: want[i] for i in range(len(rows))}


def test_edge_cases(spark):
    rows = [(None, None, None, None, None, None), (1, "src0", 5, "x" * 2_000_000, "", ""), (1, "src0", 5, "x", "", ""), (2, "", -3, "", "", ""), (2, "", -3, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns
    # of five copies src0 (weight 4 of 6) gets three, the null source and the empty one (1 of 6) one each
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert got == {(None, None): 1, (1, "src0"): 3, (2, ""): 1}
    every = [r["__copies"] for r in copies(df.drop("__q")).collect()]
    assert sorted(every) == [0, 1, 1, 1, 2]  # each of two equal rows has the whole part of its share or one more
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0
