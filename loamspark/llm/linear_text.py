"""Hashed n-gram features of texts, and scores that are means of weights over a text's features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, Words, chunks, mix, text_buffers

#: One kind of feature: a bucket for each feature of a chunk of texts, and the row it belongs to.
Features = tuple[np.ndarray, np.ndarray]


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> Features:
    """Buckets of the runs of n bytes of each text."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(m, np.uint64)
    space = data <= 32
    ok = np.ones(m, bool)
    for k in range(n):
        code = (code << U64(8)) | np.where(space[k : m + k], 32, data[k : m + k]).astype(np.uint64)
    inner = offsets[1:-1]
    for k in range(1, n):  # runs that cross from text to text
        at = inner - k
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    bucket = ((code[at] * U64(0x9E3779B97F4A7C15) + U64(n)) * U64(0xD6E8FEB86659FD93) >> U64(64 - bits)).astype(np.int64)
    return bucket, np.searchsorted(offsets, at, "right") - 1


def char_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts (its bytes, the first lowest), and the texts' offsets in characters."""
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    if first.all():
        return data.astype(np.uint32), offsets
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(data)))
    codes = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        codes[long] |= data[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return codes, np.searchsorted(starts, offsets)


def char_grams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> Features:
    """Buckets of the runs of n characters of each text that have white space at their ends only."""
    codes, offsets = char_codes(data, offsets)
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = codes <= 32
    codes = np.where(space, np.uint32(32), codes).astype(np.uint64)
    code = np.full(m, n, np.uint64)
    ok = np.ones(m, bool)
    for k in range(n):
        code = code * U64(0x9E3779B97F4A7C15) + codes[k : m + k]
        if 0 < k < n - 1:
            ok &= ~space[k : m + k]
    inner = offsets[1:-1]
    for k in range(1, n):  # runs that cross from text to text
        at = inner - k
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    code = code[at]
    bucket = ((code ^ (code >> U64(32))) * U64(0xD6E8FEB86659FD93) >> U64(64 - bits)).astype(np.int64)
    return bucket, np.searchsorted(offsets, at, "right") - 1


def word_grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[Features]:
    """Buckets of the words and of the pairs of consecutive words of each text.

    A word that follows itself is one and the same feature, whatever the word.
    """
    w = Words(data, offsets)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    h = w.hashes()
    pair = np.where(h[:-1] == h[1:], U64(0x2545F4914F6CDD1D), mix(h[:-1] * U64(3) + h[1:])) if len(h) else h
    same = row[1:] == row[:-1]
    shift = U64(64 - bits)
    return [((h >> shift).astype(np.int64), row), ((pair[same] >> shift).astype(np.int64), row[1:][same])]


def bags(texts, features: Callable, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each of an Arrow column's texts its buckets and their shares, which add up to 1."""
    data, offsets = text_buffers(texts)
    index, share = [], []
    for a, b in chunks(offsets):
        parts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        bucket, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, counts = np.unique(row * buckets + bucket, return_counts=True)
        edges = np.searchsorted(keys, np.arange(b - a + 1) * buckets)
        for r in range(b - a):
            c = counts[edges[r] : edges[r + 1]]
            index.append(keys[edges[r] : edges[r + 1]] - r * buckets)
            share.append((c / max(1, c.sum())).astype(np.float32))
    return index, share


def dense(index: list[np.ndarray], share: list[np.ndarray], buckets: int) -> np.ndarray:
    out = np.zeros((len(index), buckets), np.float32)
    for r, (i, s) in enumerate(zip(index, share)):
        out[r, i] = s
    return out


def mean_scores(texts, features: Callable, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of an Arrow column with each text's mean of weights (buckets x scores) over its features, and their number."""
    data, offsets = text_buffers(texts)
    columns = [np.ascontiguousarray(weights[:, k]) for k in range(weights.shape[1])]
    for a, b in chunks(offsets):
        n = b - a
        total, count = np.zeros((n, len(columns))), np.zeros(n)
        for bucket, row in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            count += np.bincount(row, minlength=n)
            for k, c in enumerate(columns):
                total[:, k] += np.bincount(row, c[bucket], minlength=n)
        yield a, b, total / np.maximum(count, 1)[:, None], count


def bounded_bags(docs: DataFrame, marked: DataFrame, on: list[str], by: str, most: int, features: Callable, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Label, buckets and shares of at most `most` rows of each value of `by`, in a fixed order.

    docs: the columns `on` and text; marked: `on` and `by`. The ids of the least hash are taken, then of
    the rows with these ids, however often they are repeated, the first by (hash of the id, hash of the text).
    Features are counted on the executors: the driver gets at most `most` rows of at most `buckets`
    numbers a label, never a text.
    """
    h = F.xxhash64(F.lit(29), "doc_id")
    first = Window.partitionBy(by).orderBy(h, "doc_id")
    ids = marked.filter(F.col(by).isNotNull() & F.col("doc_id").isNotNull()).distinct().withColumn("__nth", F.row_number().over(first)).filter(F.col("__nth") <= most).select(*dict.fromkeys([*on, by]))
    # at most `most` ids of each label, and labels are few
    rows = docs.filter(F.trim("text") != "").join(F.broadcast(ids), on).select(F.col(by).cast("string").alias("label"), h.alias("h"), "doc_id", F.xxhash64("text").alias("key"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, share = bags(batch.column("text"), features, buckets)
            ends = np.append(0, np.cumsum([len(i) for i in index])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t))) for x, t in ((index, np.int32), (share, np.float32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "h", "doc_id", "key")), *lists], names=["label", "h", "doc_id", "key", "index", "share"])

    counted = rows.mapInArrow(count, "label string, h long, doc_id long, key long, index array<int>, share array<float>")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id", "key"))
    got = counted.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth", "doc_id").toArrow()
    labels = np.array(got.column("label").to_pylist(), dtype=object)
    order = np.lexsort([got.column(c).to_numpy() for c in ("key", "h")] + [labels.astype(str)])
    index, share = (_views(got.column(c)) for c in ("index", "share"))
    return labels[order], [index[i] for i in order], [share[i] for i in order]


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays that share its memory."""
    out = []
    for chunk in column.chunks:
        ends, values = np.asarray(chunk.offsets), chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return out
