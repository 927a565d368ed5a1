import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loamspark.llm import suffix_dedup as module
from loamspark.llm.suffix_dedup import refine, repeated_spans

SCHEMA = "doc_id long, text string, key string, at string"


def brute(rows, n):
    """The covered word positions of each (doc_id, text)."""
    times = Counter(tuple(t.split()[i : i + n]) for _, t in rows if t for i in range(len(t.split()) - n + 1))
    out = {}
    for d, t in rows:
        w = (t or "").split()
        got = {k for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        if got:
            out[(d, t)] = got
    return out


def covered(df, rows):
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, texts[r.doc_id]), set()).update(range(r.start_word, r.end_word))
        assert texts[r.doc_id][r.start_char : r.end_char].split() == texts[r.doc_id].split()[r.start_word : r.end_word]
    return out


def test_refine_gives_the_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 300):
        for block in (1, 20, 1 << 16):
            keys = rng.integers(0, 3, n)
            order, _ = refine(keys, 1, n + 1, block)
            assert order.tolist() == sorted(range(n), key=lambda i: keys[i:].tolist())


def test_refine_against_sorting_slices():
    rng = np.random.default_rng(2)
    for trial in range(400):
        n, q, depth, block = int(rng.integers(1, 120)), int(rng.integers(1, 12)), int(rng.integers(1, 30)), int(rng.integers(1, 60))
        keys = rng.integers(0, int(rng.integers(1, 5)), n).astype(np.uint64)
        if trial % 3 == 0:
            keys[n // 3 : n // 3 * 2] = keys[: n // 3]
        order, pointer = refine(keys, q, depth, block)
        k = keys.tolist()
        assert sorted(order.tolist()) == list(range(n))
        assert all(k[x : x + depth] <= k[y : y + depth] for x, y in zip(order[:-1], order[1:]))
        groups = {}
        for i in range(n):
            groups.setdefault(tuple(k[i : i + depth]) if i + depth <= n else i, set()).add(int(pointer[i]))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
        place = np.empty(n, int)
        place[order] = np.arange(n)
        assert all(pointer[i] == place[pointer == pointer[i]].max() for i in range(n))


def passages(seed, texts=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 3)))
    shared = [[word() for _ in range(rng.randint(12, 60))] for _ in range(6)]
    rows = []
    for d in range(texts):
        w = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(texts + 1, " ".join(["x"] * 40))]  # repeats itself


@pytest.mark.parametrize("sort_words, batch", [(1, 1), (1, 7), (40, 3), (300, 5), (2_000, 1000)])
def test_buckets_over_batches(monkeypatch, sort_words, batch):
    # as executors do it, with so little sorted at a time that buckets go over batches and parts
    monkeypatch.setattr(module, "SORT_WORDS", sort_words)
    rows, n = passages(sort_words + batch), 12
    rows += [(100 + k, rows[3][1]) for k in range(25)]  # slices with many copies
    table = pa.table({"doc_id": [d for d, _ in rows], "key": [hash(t) for _, t in rows], "text": [t for _, t in rows]})
    found = pa.Table.from_batches(module._anchors(n)(table.to_batches())).to_pandas()
    found = found[found.groupby("anchor")["key"].transform("size") > 1]
    at = {k: sorted(set(v)) for k, v in found.groupby("key")["at"]}
    table = table.filter(pa.array([k in at for k in table.column("key").to_pylist()]))
    table = table.append_column("at", pa.array([at[k] for k in table.column("key").to_pylist()], pa.list_(pa.int32())))
    slices = pa.Table.from_batches(module._slices(n)(table.to_batches())).sort_by("anchor").combine_chunks()
    got = {}
    for part in module._sorted_buckets(n)(slices.to_batches(max_chunksize=batch)):
        for r in part.to_pylist():
            got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == {d: w for (d, _), w in brute(rows, n).items()}


def test_against_brute_force(spark):
    rows = passages(3)
    got = covered(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 12), rows)
    assert got == brute(rows, 12)


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", None), (1, text, "a", None), (None, "z " + text, None, None), (2, None, "", ""), (3, "", "", ""), (4, " ".join(f"v{i}" for i in range(40_000)), "", "")]
    got = repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.n_copies) for r in got} == {(1, 0, 60, 3), (None, 1, 61, 3)}
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passage_of_fifty_words_but_not_of_forty_nine(spark):
    rng = random.Random(5)
    fill = lambda n: [f"u{rng.random()}" for _ in range(n)]
    long, short = fill(50), fill(49)
    rows = [(d, " ".join(fill(30) + p + fill(30))) for d, p in enumerate([long, long, short, short])]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.keep) for r in got) == [(0, 30, 80, True), (1, 30, 80, False)]
