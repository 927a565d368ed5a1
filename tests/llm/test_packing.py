import random
from collections import Counter, defaultdict

from loamspark.llm.packing import packed, plan

SCHEMA = "doc_id long, text string, n string, key string, piece string"


def one_by_one(sizes, capacity):
    """Bins by placing piece after piece: large ones matched, small ones best fit."""
    sizes = sorted(sizes, reverse=True)
    large = [s for s in sizes if 3 * s > capacity]
    bins = []
    while large:
        a = large.pop(0)
        k = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        bins.append([a] + ([large.pop(k)] if k is not None else []))
    for s in (s for s in sizes if 3 * s <= capacity):
        fits = [b for b in bins if sum(b) + s <= capacity]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    return bins


def bins_of(counts, capacity):
    rows, n = plan(counts, capacity)
    bins, ends = defaultdict(list), defaultdict(list)
    for size, lo, hi, per, first, place in rows:
        for r in range(hi - lo):
            bins[first + r // per].append(size)
            ends[first + r // per].append((place + r % per * size, place + (r % per + 1) * size))
    assert sorted(bins) == list(range(n))
    for e in ends.values():
        e.sort()
        assert e[0][0] == 0 and e[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(e, e[1:]))
    return bins


def test_plan_is_what_placing_one_by_one_gives():
    rng = random.Random(1)
    for trial in range(150):
        capacity = rng.choice([10, 30, 64, 100])
        sizes = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.randint(0, 120))]
        got, want = bins_of(Counter(sizes), capacity), one_by_one(sizes, capacity)
        assert sorted(s for b in got.values() for s in b) == sorted(sizes)
        assert sorted(map(sum, got.values())) == sorted(map(sum, want))
        assert all(sum(3 * s > capacity for s in b) <= 2 for b in got.values())


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), "", "", "") for i in range(300)]
    rows += [(7, rows[7][1], "", "", "")] * 3 + [(None, "a b c", None, None, None), (None, None, None, None, None), (400, "", "", "", ""), (401, " \n", "", "", ""), (402, "v " * 100_000, "", "", "")]
    got = packed(spark.createDataFrame(rows, SCHEMA), 32).collect()
    want = Counter()
    for d, t, *_ in rows:
        for a in range(0, len((t or "").split()), 32):
            want[(d, a, min(32, len(t.split()) - a))] += 1
    assert Counter((r.doc_id, r.start_word, r.n_words) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append((r.start_in_bin, r.start_in_bin + r.n_words))
    for e in bins.values():
        e.sort()
        assert e[0][0] == 0 and e[-1][1] <= 32 and all(a[1] == b[0] for a, b in zip(e, e[1:]))
    assert len(bins) == len(one_by_one([r.n_words for r in got], 32)) == max(bins) + 1
    assert packed(spark.createDataFrame([], SCHEMA)).count() == 0
