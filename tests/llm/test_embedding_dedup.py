import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loamspark.llm import embedding_dedup as module
from loamspark.llm.embedding_dedup import LEAST, _nodes, embedding_groups, near_pairs

SCHEMA = "vec_id long, embedding array<float>, label int, node string, vector string"


def vectors(groups=120, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 8)):
            out.append(base + rng.standard_normal(dim) * 0.12)
    return np.array(out)


def test_recall_against_brute_force(spark):
    v = vectors()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = [(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= LEAST, 1)))]
    df = spark.createDataFrame([(i, [float(x) for x in r], 0, "", "") for i, r in enumerate(v)], SCHEMA)
    group = {r.vec_id: r.group_id for r in embedding_groups(df).collect()}
    found = sum(group.get(int(i), -1) == group.get(int(j), -2) for i, j in near)
    assert len(near) > 300 and found >= 0.9 * len(near)
    # every group hangs together by near pairs
    label = list(range(len(v)))
    for i, j in near:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    assert all(label[i] == label[g] for i, g in group.items())


def test_windows_do_not_end_with_partitions(spark):
    # with a window as wide as the table one pass finds every pair, however rows are partitioned
    v = vectors(30, 8, 2)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = int((np.triu(u @ u.T >= 0.8, 1)).sum())
    df = spark.createDataFrame([(i, [float(x) for x in r], 0, "", "") for i, r in enumerate(v)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = near_pairs(_nodes(df), 0.8, 1, len(v)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == len({tuple(sorted(p)) for p in got}) == want


def test_edge_cases(spark):
    one, other = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(1, one), (1, one), (2, [2.0, 4.0, 6.0]), (None, one), (3, other), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0]), (9, [float("nan"), 1.0, 1.0]), (10, [float("inf"), 1.0, 1.0]), (11, [1.0, 2.0]), (12, [1.0, 2.0]), (9, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)
    got = sorted((r.vec_id or -1, r.group_id, r.n_members, r.keep) for r in embedding_groups(df).collect())
    assert got == [(-1, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (11, 11, 2, True), (12, 11, 2, False)]
    assert embedding_groups(df.limit(0)).count() == 0


def planted(n, pairs, dim=64, seed=3):
    """Unit vectors; those at i and pairs + i have a cosine of 0.95 to 0.96."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim), dtype=np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    a, c = v[:pairs], rng.uniform(0.951, 0.96, (pairs, 1))
    o = rng.standard_normal((pairs, dim))
    o -= (o * a).sum(1)[:, None] * a
    v[pairs : 2 * pairs] = c * a + np.sqrt(1 - c * c) * o / np.linalg.norm(o, axis=1)[:, None]
    return v


def test_recall_does_not_fall_with_the_table():
    n, pairs = 400_000, 2_000
    v, hit = planted(n, pairs), np.zeros(2_000, bool)
    for nth in range(module.passes_for(n) if hasattr(module, "passes_for") else module.PASSES):
        place = np.empty(n, np.int64)
        place[np.argsort(module.sort_keys(v, nth, module.SEED), kind="stable")] = np.arange(n)
        hit |= np.abs(place[:pairs] - place[pairs : 2 * pairs]) <= module.NEIGHBOURS
    assert hit.mean() >= 0.93


@pytest.mark.parametrize("partitions", [1, 7, 40, 150])
def test_windows_over_many_ends(spark, partitions):
    # every pair at most `width` places apart in the whole order, and no other, even with fewer rows than that in a partition
    v, width = vectors(60, 8, 4), 9
    u = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 0, "", "") for i, r in enumerate(v)], SCHEMA)
    nodes = _nodes(df)
    node = {r.vec_id: r.node for r in nodes.collect()}
    order = sorted(range(len(v)), key=lambda i: (int(module.sort_keys(u, 0, module.SEED)[i]), node[i]))
    want = {frozenset((node[a], node[b])) for k, a in enumerate(order) for b in order[k + 1 : k + 1 + width] if float(u[a] @ u[b]) >= 0.8}
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [frozenset(p) for p in near_pairs(nodes, 0.8, 1, width).collect()]
    finally:
        for c, x in was.items():
            spark.conf.set(c, x)
    assert set(got) == want and len(got) == len(want) > 50


def test_recall_of_the_query_over_tens_of_thousands(spark, tmp_path):
    # near copies planted among 30,000 vectors, found by the registered query's own steps; brute force by blocks
    n, pairs = 30_000, 1_500
    v = planted(n, pairs, 64, 9)
    rng = np.random.default_rng(10)
    v[2 * pairs : 2 * pairs + 300] = v[:300]  # exact copies
    v[2 * pairs + 300 : 2 * pairs + 600] = v[300:600] * rng.uniform(0.5, 2, (300, 1))  # of another length
    order = rng.permutation(n)
    table = pa.table({"vec_id": pa.array(order), "embedding": pa.array(list(v)), "label": pa.array(np.zeros(n, np.int32))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = set()
    for a in range(0, n, 2_000):
        i, j = np.nonzero(u[a : a + 2_000] @ u.T >= LEAST)
        near |= {(int(order[x + a]), int(order[y])) for x, y in zip(i, j) if x + a < y}
    rows = module.op8_embedding_dedup(spark, str(tmp_path)).collect()
    group = {r.vec_id: r.group_id for r in rows}
    assert len(near) >= pairs + 600
    assert sum(group.get(x, -1) == group.get(y, -2) for x, y in near) >= 0.9 * len(near)
    assert set(group) <= {x for p in near for x in p}  # and nothing else
    assert sum(r.keep for r in rows) == len(set(group.values()))


def test_copies_take_no_places(spark):
    # a window as wide as the number of distinct vectors still holds all of them
    v = vectors(30, 8, 2)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = int((np.triu(u @ u.T >= 0.8, 1)).sum())
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, embedding array<float>")
    often = df.selectExpr("explode(sequence(0, 19)) as k", "i", "embedding").selectExpr(f"k * {len(v)} + i as vec_id", "embedding")
    assert near_pairs(_nodes(often), 0.8, 1, len(v)).count() == want
    groups = embedding_groups(often, 1.1).selectExpr("count(*)", "sum(int(keep))", "min(n_members)", "max(n_members)", "max(group_id)").first()
    assert tuple(groups) == (20 * len(v), len(v), 20, 20, len(v) - 1)
