import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamspark.llm import simhash_dedup as module
from loamspark.llm.components import connected_components
from loamspark.llm.kernels import text_buffers
from loamspark.llm.simhash_dedup import MOST, _forest, _linked, copy_groups, fingerprints, near_pairs, without_copies

SCHEMA = "doc_id long, text string, key string, root string, __key string"


def prints(texts):
    return fingerprints(*text_buffers(pa.array(texts)))


def corpus(seed=1, groups=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiö", k=rng.randint(2, 7))) for _ in range(3000)]
    rows, of = [], []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(40, 400))
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice(vocabulary) if rng.random() < 0.04 else x for x in base]
            rows.append((len(rows), " ".join(w)))
            of.append(g)
    return rows, of


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_groups_against_brute_force(spark):
    rows, of = corpus()
    sig, _ = prints([t for _, t in rows])
    n = len(rows)
    label = list(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if np.bitwise_count(sig[i] ^ sig[j]).sum() <= MOST and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r.doc_id: r.group_id for r in copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if label[i] == label[j]]
    found = sum(got.get(i, -1) == got.get(j, -2) for i, j in pairs)
    assert found >= 0.9 * len(pairs)
    assert all(of[i] == of[g] for i, g in got.items())  # nothing that isn't a copy


def test_edge_cases(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(100))
    long = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(60_000))
    rows = [(1, text, "x", "y", "z"), (1, text, "x", "y", "z"), (None, text.upper(), None, None, None), (3, None, "", "", ""), (None, None, "", "", ""), (4, "", "", "", ""), (5, "", "", "", ""), (6, "!!! ...", "", "", ""), (7, long, "", "", ""), (8, long, "", "", ""), (9, "other words here", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id or -1), r.group_id, r.n_members, r.keep) for r in copy_groups(df).collect())
    assert got == [(-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (7, 7, 2, True), (8, 7, 2, False)]
    left = without_copies(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3, 4, 5, 6, 7, 9]
    empty = spark.createDataFrame([], SCHEMA)
    assert copy_groups(empty).count() == 0 and without_copies(empty).count() == 0


def test_recall_at_each_distance(spark):
    rng, pairs = np.random.default_rng(5), 2_000
    distances = [1, 15, 17, 24, 30, 35, 37, 38, 39, 40]
    one = rng.integers(0, 2, (pairs * len(distances), 256), dtype=np.uint8)
    flips = np.argsort(np.argsort(rng.random(one.shape), 1), 1) < np.repeat(distances, pairs)[:, None]
    sigs = np.packbits(np.concatenate([one, one ^ flips]), axis=1)
    nodes = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(sigs)), "sig": [s.tobytes() for s in sigs]}), "i long, sig binary").withColumn("node", F.xxhash64("sig"))
    at = {r.node: r.i for r in nodes.select("node", "i").collect()}
    found = {tuple(sorted((at[p.u], at[p.v]))) for p in near_pairs(nodes).collect()}
    for k, d in enumerate(distances):
        recall = sum((i, len(one) + i) in found for i in range(k * pairs, (k + 1) * pairs)) / pairs
        assert recall == 1 if d <= 15 else recall >= 0.9, (d, recall)


def connected(pairs):
    label = {}
    for i, j in pairs:
        a, b = label.setdefault(i, {i}), label.setdefault(j, {j})
        if a is not b:
            a |= b
            for x in b:
                label[x] = a
    return {frozenset(x) for x in label.values()}


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(7)
    for n in (1, 2, 25, 200):
        bits = rng.integers(0, 2, (n, 256), dtype=np.uint8)
        for i in range(1, n):
            if rng.random() < 0.6:  # chains of copies, each a few bits from one before it
                bits[i] = bits[rng.integers(0, i)] ^ (rng.random(256) < 0.1)
        sig = np.packbits(bits, axis=1).view(np.uint64)
        members = rng.permutation(n)
        edges = _forest(members, sig, MOST).tolist()
        near = [(i, j) for i in range(n) for j in range(i) if (bits[i] != bits[j]).sum() <= MOST]
        assert connected(edges) == connected(near)
        assert len(edges) == sum(len(g) - 1 for g in connected(near))
        assert all((bits[i] != bits[j]).sum() <= MOST for i, j in edges)


def test_big_groups_that_share_a_variant():
    # rows of one route with one variant, more than are compared pair by pair
    rng = np.random.default_rng(8)
    n = 4_000
    bits = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    bits[:, :30] = bits[0, :30]
    bits[n // 2 :] = bits[: n // 2]
    bits[n // 2 :, 40:60] ^= 1
    began = time.process_time()
    u, v = _linked(np.zeros(n, np.int64), module._laid(bits, module._orders()[0]), MOST)
    assert {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist())} == {(i, n // 2 + i) for i in range(n // 2)}
    assert time.process_time() - began < 30


def test_layouts_keep_every_bit():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, (2, 50, 256), dtype=np.uint8)
    for order in module._orders():
        assert sorted(order) == list(range(256))
        x, y = module._laid(a, order), module._laid(b, order)
        assert x.shape == (50, module.LAID)
        assert (np.bitwise_count(x ^ y).sum(1) == (a != b).sum(1)).all()
        halves = module._halves(x)
        for k in range(16):
            assert (halves[:, k] == a[:, order[16 * k : 16 * k + 15]] @ (1 << np.arange(14, -1, -1))).all()


@pytest.mark.parametrize("bits", [4, 9, 15])
def test_rows_over_batches(monkeypatch, bits):
    # keys are joined whole, however few rows are held at a time and however many first bits make a key
    rng = np.random.default_rng(9)
    one = rng.integers(0, 2, (15, 256), dtype=np.uint8)
    both = np.concatenate([one, one])
    both[15:, :8] ^= 1
    sig = [b.tobytes() for b in np.packbits(both, axis=1)]
    batches = [pa.RecordBatch.from_pydict({"sig": pa.array(part, pa.binary())}) for part in (sig[:7], sig[7:], [])]
    routes = pa.Table.from_batches(module._routes(bits)(batches)).sort_by("key").combine_chunks()
    for held, rows in ((1, 1), (50, 7), (10**6, 1000)):
        monkeypatch.setattr(module, "JOIN_ROWS", held)
        found = pa.Table.from_batches(module._join(MOST)(routes.to_batches(max_chunksize=rows)))
        got = {tuple(sorted((sig.index(u), sig.index(v)))) for u, v in zip(found.column("u").to_pylist(), found.column("v").to_pylist())}
        assert got == {(i, 15 + i) for i in range(15)}
