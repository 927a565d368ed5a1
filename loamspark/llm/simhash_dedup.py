"""Operator 3: near copies by SimHash, found through deletion-variant signatures.

Each text has a fingerprint of BITS bits: the signs of the sum of its words' random vectors, a word
(lower case, without punctuation at its ends) weighing the square root of its count. Two texts are
near copies if their fingerprints differ in at most `most` bits; groups are the connected
components of that.

Candidates: the fingerprint is cut into SEGMENTS segments of 2 * HALF bits, few enough that of two
fingerprints with 2 * SEGMENTS - 1 or fewer differences one segment differs by at most one bit. A segment
with one bit deleted, with that bit's position, is a variant; two segments that differ by one bit or none
share a variant. A difference of one bit lies in one half of a segment, so a segment's variants are sent by
its other half, which is equal (one row for each half instead of one for each bit), and joined on equality
there. Fingerprints travel in rows of many, by the first bits of that half. Every pair that shares a variant
is verified on the whole fingerprints. Equal fingerprints are one node, so exact copies make no pairs.

What is guaranteed: up to 2 * SEGMENTS - 1 = 15 differences this finds every pair. Pairs with more, but
not more than `most`, are found if one segment happens to be close, so the fingerprint is also cut after
each of CUTS - 1 fixed permutations of its bits, which gives them as many more chances: CUTS is such
that of pairs that differ in `most` bits, the farthest, at least 0.9 are found (all up to 15, nearly all
up to 35). Segments short enough to guarantee 40 would be of 12 bits, which almost all texts share.
Tests hold recall at each distance, and of groups, against brute force.

Null texts and texts without words (empty, white space or punctuation only) are in no group. A null
doc_id is a row like any other and goes after the others of its group. Very long texts are read whole,
a text at a time; a sum of exactly half the weight gives a 0 bit; an empty table gives an empty result. Repeated rows are copies: one
stays. Other columns, whatever their names, are carried along by `without_copies` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import checkpointed, connected_components
from .kernels import U64, Words, chunks, mix, text_buffers

BITS, SEGMENTS, HALF, CUTS = 256, 8, 15, 9
MOST = 40
#: Bytes of a fingerprint laid out for a cut.
LAID = 4 * SEGMENTS
#: Rows that are joined together, at least, and rows that a key has, about; whole keys only.
JOIN_ROWS, KEY_ROWS = 150_000, 20_000
_SEEDS = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 letters in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        tail = out[1:]
        tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BITS // 64 words for each text, and whether it has words."""
    w = Words(data, offsets)
    n = len(w.counts)
    starts, ends = w.starts.copy(), w.ends.copy()
    while len(starts) and (more := (ends > starts) & _EDGE[data[ends - 1]]).any():
        ends -= more
    while len(starts) and (more := (ends > starts) & _EDGE[data[np.minimum(starts, len(data) - 1)]]).any():
        starts += more
    row = np.repeat(np.arange(n), w.counts)
    real = ends > starts
    h = w.hashes(lowered(data), starts[real], ends[real]) >> U64(20)
    keys = np.sort((row[real].astype(U64) << U64(44)) | h)
    out = np.zeros((n, BITS // 64), U64)
    if not len(keys):
        return out, np.zeros(n, bool)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    weight = np.sqrt(count).astype(np.float32)
    row = (keys >> U64(44)).astype(np.int64)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rows = row[first]
    half = np.add.reduceat(weight, first) / 2
    word = keys & U64(2**44 - 1)
    for j in range(BITS // 64):
        bits = np.unpackbits(mix(word * U64(_SEEDS[j]) + U64(j)).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.add.reduceat(bits * weight[:, None], first, axis=0)
        out[rows, j] = np.packbits(total > half[:, None], axis=1).view(U64).ravel()
    has = np.zeros(n, bool)
    has[rows] = True
    return out, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in chunks(offsets):
            print_, has = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), b - a, [None, pa.py_buffer(np.ascontiguousarray(print_))]).cast(pa.binary())
            part = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), sig], names=["doc_id", "key", "sig"])
            yield part.filter(pa.array(has))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id and text), node (of the fingerprint) and sig of the rows that have words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    signed = texts.withColumn("key", row_key()).mapInArrow(_sign, "doc_id long, key long, sig binary")
    return signed.select("doc_id", "key", F.xxhash64("sig").alias("node"), "sig")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary(BITS // 8))
    return np.frombuffer(column.buffers()[1], U64, len(column) * BITS // 64, column.offset * BITS // 8).reshape(-1, BITS // 64)


def _orders() -> list[np.ndarray]:
    """For each cut which bit goes where: two bytes for each half of a segment, its bits first, then one of the bits left over."""
    rng = np.random.default_rng(7)
    out = []
    for c in range(CUTS):
        bits = rng.permutation(BITS) if c else np.arange(BITS)
        places = np.empty((2 * SEGMENTS, 16), np.int64)
        places[:, :HALF] = bits[: 2 * SEGMENTS * HALF].reshape(-1, HALF)
        over = bits[2 * SEGMENTS * HALF :]
        places[:, HALF:] = over.reshape(2 * SEGMENTS, 16 - HALF)
        out.append(places.ravel())
    return out


def _laid(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of bits in the order of a cut, as bytes."""
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1))


def _halves(laid: np.ndarray) -> np.ndarray:
    """The number that each half of a laid fingerprint is."""
    return laid.view(">u2").reshape(len(laid), 2 * SEGMENTS).astype(np.int32) >> (16 - HALF)


def _routes(bits: int):
    """For each half of each segment of each cut the laid fingerprints, put together by the half's first `bits` bits.

    A row of fingerprints in `sigs` for each cut, half and value of these bits in `key`: what a
    fingerprint takes on the way is little more than its own bytes a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for batch in batches:
            n = len(batch)
            of = np.unpackbits(np.ascontiguousarray(_matrix(batch.column("sig"))).view(np.uint8), axis=1)
            for c, order in enumerate(orders):
                laid = _laid(of, order)
                halves = _halves(laid).T
                key = (halves >> (HALF - bits)) | ((np.arange(len(halves), dtype=np.int32) + c * 2 * SEGMENTS) << 16)[:, None]
                key, row = key.ravel(), np.tile(np.arange(n), len(halves))
                by = np.argsort(key, kind="stable")
                key = key[by]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                ends = np.append(new, len(key)).astype(np.int32) * LAID
                sigs = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(laid[row[by]]))])
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), sigs], names=["key", "sigs"])

    return run


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1) <= most


def _linked(place: np.ndarray, laid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as rows of `laid`, of the verified pairs that share a variant.

    place: the cut and half that a row was sent by. Rows of the same place and half share a variant if the
    segment's other half is equal without one of its bits.
    """
    n = len(place)
    h = _halves(laid)
    half = place % (2 * SEGMENTS)
    route = (place << HALF) | h[np.arange(n), half]
    by = np.argsort(route, kind="stable")
    route, other, sig = route[by], h[by, half[by] ^ 1].astype(U64), np.ascontiguousarray(laid[by]).view(U64)
    group = np.cumsum(np.append(0, route[1:] != route[:-1])).astype(U64) << U64(HALF - 1)
    found: list[np.ndarray] = []
    for bit in range(HALF):
        rest = ((other >> U64(bit + 1)) << U64(bit)) | (other & U64((1 << bit) - 1))
        key = group | rest
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, n))
        for s, m in zip(start[size > 24], size[size > 24]):
            found.append(_forest(order[s : s + m], sig, most))
        size = np.repeat(np.where(size > 24, 0, size), size)
        left = np.arange(n)
        end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
        lag = 1
        left = left[size > 1]
        while len(left := left[left + lag < end[left]]):
            i, j = order[left], order[left + lag]
            near = _near(sig[i], sig[j], most)
            if near.any():
                found.append(np.stack([i[near], j[near]], 1))
            lag += 1
    if not found:
        return by[:0], by[:0]
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return by[pairs[:, 0]], by[pairs[:, 1]]


def _forest(members: np.ndarray, sig: np.ndarray, most: int) -> np.ndarray:
    """Edges that connect what is connected by verified pairs of members, one less than a component has.

    Every pair that isn't connected otherwise is compared, so members of which few are near cost the
    square of their number, half of the fingerprint for almost all; what a pivot reaches is compared no more.
    """
    edges, waiting = [], members
    columns = [np.ascontiguousarray(c) for c in sig[members].T]  # of those that wait
    of = dict(zip(members.tolist(), sig[members]))
    count = lambda c, p: np.bitwise_count(c ^ p)
    while len(waiting):
        queue, waiting, columns = [int(waiting[0])], waiting[1:], [c[1:] for c in columns]
        while queue and len(waiting):
            pivot = of[pivot_at := queue.pop()]
            # with half of the bits far apart already the rest isn't looked at
            half = len(columns) // 2
            first = sum(count(c, p) for c, p in zip(columns[:half], pivot[:half]))
            near = np.flatnonzero(first <= most)
            if len(near):
                rest = sum(count(c[near], p).astype(np.int64) for c, p in zip(columns[half:], pivot[half:]))
                near = near[first[near] + rest <= most]
            if len(near):
                reached = waiting[near]
                edges.append(np.stack([np.full(len(reached), pivot_at), reached], 1))
                queue.extend(reached.tolist())
                stays = np.ones(len(waiting), bool)
                stays[near] = False
                waiting, columns = waiting[stays], [c[stays] for c in columns]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _join(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = [np.argsort(order) for order in _orders()]

        def linked(keys: list[np.ndarray], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            place, laid = np.concatenate(keys) >> 16, np.concatenate(parts).reshape(-1, LAID)
            u, v = _linked(place, laid, most)
            cut = place[u] // (2 * SEGMENTS)
            for c in np.unique(cut):
                of = cut == c
                ends = [np.packbits(np.unpackbits(laid[x[of]], axis=1)[:, back[c]], axis=1) for x in (u, v)]
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for x in ends], names=["u", "v"])

        keys: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column("sigs")
            ends = np.frombuffer(column.buffers()[1], np.int32, len(batch) + 1, column.offset * 4)
            data = np.frombuffer(column.buffers()[2], np.uint8)
            for i, key in enumerate(batch.column("key").to_numpy()):
                if held >= JOIN_ROWS and keys[-1][0] != key:  # keys are held and joined whole
                    yield from linked(keys, parts)
                    keys, parts, held = [], [], 0
                parts.append(data[ends[i] : ends[i + 1]])
                keys.append(np.full(len(parts[-1]) // LAID, key, np.int64))
                held += len(keys[-1])
        if held:
            yield from linked(keys, parts)

    return run


def near_pairs(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs u, v of nodes (node, sig; node is the hash of sig) that share a variant and are near; enough to connect the groups."""
    once = nodes.select("node", "sig").dropDuplicates(["node"])
    # so many first bits of a half are put together that a key has about KEY_ROWS rows, however large the table
    bits = min(HALF, max(4, (nodes.count() // KEY_ROWS).bit_length()))
    routes = once.mapInArrow(_routes(bits), "key int, sigs binary")
    pairs = routes.repartition("key").sortWithinPartitions("key").mapInArrow(_join(most), "u binary, v binary")
    return pairs.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))


def _grouped(docs: DataFrame, most: int) -> DataFrame:
    signed = checkpointed(signatures(docs))
    roots = connected_components(near_pairs(signed, most))
    return signed.drop("sig").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def copy_groups(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group), n_members and keep, for groups of two or more.

    keep: the row that stays, the first by (doc_id, hash of doc_id and text), nulls last.
    """
    all_ = Window.partitionBy("root")
    first = all_.orderBy(F.asc_nulls_last("doc_id"), "key")
    return (
        _grouped(docs, most)
        .withColumns({"n_members": F.count(F.lit(1)).over(all_), "group_id": F.min("doc_id").over(all_), "n": F.row_number().over(first)})
        .filter("n_members > 1")
        .select("doc_id", "group_id", "n_members", (F.col("n") == 1).alias("keep"))
    )


def without_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs with one row of each group; all its columns, and the rows that are in no group."""
    dropped = "__key" + "_" * sum(c.startswith("__key") for c in docs.columns)
    stays = _grouped(docs, most).groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias(dropped)).select(dropped, F.lit(True).alias(dropped + "s"))
    listed = _listed_keys(docs, dropped)
    joined = listed.join(stays, dropped, "left")
    nth = F.row_number().over(Window.partitionBy(dropped).orderBy(dropped))
    return joined.withColumn(dropped + "n", nth).filter(F.col(dropped + "w") | (F.col(dropped + "s") & (F.col(dropped + "n") == 1))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _listed_keys(docs: DataFrame, name: str) -> DataFrame:
    """docs with each row's key, and in name + 'w' whether its text has no word."""
    wordless = F.coalesce(~F.col("text").cast("string").rlike("[^\\x00-\\x20!-/:-@\\[-`{-~]"), F.lit(True))
    return docs.withColumn(name, row_key()).withColumn(name + "w", wordless)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
