"""Operator 7: best-fit packing of documents into bins of a fixed capacity, large ones matched first.

A document's size is its number of white-space separated words. One of more than `capacity` words is
cut into pieces of that size and a rest. Pieces above a third of the capacity are large: at most two
fit a bin, and each, from the largest on, is matched with the largest one that still fits beside it.
Then the smaller ones, from the largest on, go each into the bin with the least gap that holds them,
or into a new bin.

Equal sizes are alike, so the plan is made over the number of pieces of each size (at most `capacity`
numbers, whatever the corpus) and is what placing the pieces one by one would give. It says for each
size which ranks go to which bins; ranks are counted within (size, hash) groups of about GROUP_ROWS
pieces with an offset for each, so no size is sorted whole. The plan has a few rows a size; nothing
else comes to the driver.

Null, empty and blank texts take no room and have no row. A null doc_id is packed like any other, and
so is each of repeated rows; pieces of one size are ranked by (hash, doc_id, hash of the row, piece), nulls
last, equal ones in any order. Very long texts are cut into pieces like others. An empty table gives an empty result. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import checkpointed

CAPACITY = 2048
#: About so many pieces of a size are ranked together: a size has a group for each, so groups grow with the corpus.
GROUP_ROWS = 20_000
#: Up to so many rows (of 48 bytes at most) the plan is broadcast; beyond, it is joined like any table.
BROADCAST_ROWS = 200_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces go: rows (size, lo, hi, a bin's number of them, first bin, place of the first in its bin), and the number of bins.

    The pieces of a size with ranks from lo on, below hi, fill bins from the first bin on.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int, int]] = []
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first bin, bins)
    bins = 0

    def put(size: int, n: int, per: int, first: int, place: int) -> None:
        out.append((size, taken[size], taken[size] + n, per, first, place))
        taken[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        k = bisect_left(large, capacity - a + 1)
        for b in reversed(large[:k]):
            if left[a] == 0 or b > a:
                if left[a] == 0:
                    break
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                if a == b:
                    put(a, 2 * n, 2, bins, 0)
                else:
                    put(a, n, 1, bins, 0)
                    put(b, n, 1, bins, a)
                blocks[capacity - a - b].append((bins, n))
                bins += n
        if left[a]:
            n = left[a]
            put(a, n, 1, bins, 0)
            blocks[capacity - a].append((bins, n))
            bins += n
    gaps = sorted(g for g in blocks if g)

    def free(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not blocks[gap]:
                insort(gaps, gap)
            blocks[gap].append((first, n))

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                first, n = bins, -(-left[s] // per)
                gap = capacity
                bins += n
            else:
                gap = gaps[at]
                first, n = blocks[gap].pop()
                if not blocks[gap]:
                    gaps.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            place = capacity - gap
            if full:
                put(s, full * per, per, first, place)
                free(gap - per * s, first, full)
            first, n = first + full, n - full
            if n and left[s]:
                rest = left[s]
                put(s, rest, rest, first, place)
                free(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            free(gap, first, n)
    return out, bins


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id and start_in_bin: a row for each piece.

    Texts are read once: the size of each document is written, a few numbers a row, and the rest works on these.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x00-\x20]+")).alias("n"), F.xxhash64("doc_id", "text").alias("key")).filter("n > 0")
    sized = checkpointed(sized)
    pieces = sized.select("doc_id", "key", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity))).alias("piece", "start_word"))
    pieces = pieces.select("doc_id", "key", "piece", "start_word", F.least(F.col("n") - F.col("start_word"), F.lit(capacity)).alias("n_words"))
    counts = {r["n_words"]: r["k"] for r in pieces.groupBy("n_words").agg(F.count(F.lit(1)).alias("k")).collect()}
    if not counts:
        return pieces.select("doc_id", "piece", "start_word", "n_words", F.lit(0).cast("long").alias("bin_id"), F.lit(0).alias("start_in_bin"))
    # at most capacity sizes, and a few rows of the plan for each: small whatever the corpus
    groups_of = spark.createDataFrame([(s, max(1, -(-k // GROUP_ROWS))) for s, k in counts.items()], "n_words int, groups long")
    rows, _ = plan(counts, capacity)
    planned = spark.createDataFrame(rows, "n_words int, lo long, hi long, per long, first long, place int")
    pieces = pieces.join(_small(groups_of, len(counts)), "n_words").withColumn("g", F.pmod(F.xxhash64("key", "piece"), F.col("groups"))).drop("groups")
    before = Window.partitionBy("n_words").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("n_words", "g").agg(F.count(F.lit(1)).alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    nth = F.row_number().over(Window.partitionBy("n_words", "g").orderBy(F.asc_nulls_last("doc_id"), "key", "piece"))
    ranked = pieces.withColumn("nth", nth).join(offsets, ["n_words", "g"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    placed = ranked.join(_small(planned, len(rows)), "n_words").filter("rank >= lo and rank < hi").withColumn("at", F.col("rank") - F.col("lo"))
    return placed.select(
        "doc_id",
        "piece",
        "start_word",
        "n_words",
        (F.col("first") + F.expr("at div per")).alias("bin_id"),
        (F.col("place") + F.expr("at % per") * F.col("n_words")).cast("int").alias("start_in_bin"),
    )


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, broadcast unless a capacity has made it large."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
