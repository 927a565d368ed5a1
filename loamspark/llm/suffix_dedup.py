"""Operator 1: repeated passages by a distributed suffix array with bucket-pointer refinement.

A position is *repeated* when the `min_words` words from it on also stand somewhere else in the
corpus (in another text or in the same one). A span is a maximal run of words that such windows
cover. Words are separated by white space and compared byte for byte.

1. q-gram buckets: every window of `min_words` words has one minimizer, its `ANCHOR`-word gram of
   least hash. All copies of a window choose the same one, so the gram's bucket decides where the
   window's suffixes are sorted. Buckets with one member are final (a suffix that is alone in its
   bucket needs no refinement) and go no further; about one word in twenty starts a gram.
2. Texts with a bucket of two or more are joined to their buckets by a hash of the text, and the
   slice of words that such a bucket's windows cover goes to the bucket's partition.
3. There `refine` sorts the suffixes of whole buckets: initial q-gram buckets, then bucket after
   bucket by the pointers of later offsets, recursively, each reading the pointers that those before it
   have updated, until the pointers tell `min_words` words apart. Suffixes that still share a bucket are
   the repeats. Equal
   slices are held and sorted once, so a passage with very many copies doesn't fill a task.
4. Runs of repeated windows are merged to spans for each text.

Nothing is broadcast or gathered by this code; the result is exact but for 64-bit hash collisions.

Null and empty texts, and texts under `min_words` words, have no span. A null doc_id is carried as
null. Repeated rows repeat each other: every copy has its spans, and rows equal in doc_id and text
share them. Very long texts are read whole, a text at a time; an empty table gives an empty result. Of the copies of a window the first by (doc_id, text hash, position), nulls first, is
the one to keep: to be cut are the words of spans with keep false that no span with keep true covers.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import U64, Words, char_positions, chunks, grams, signed, sliding_min, text_buffers

MIN_WORDS = 50
ANCHOR = 15
#: Words of slices that are sorted together, at least; whole buckets only.
SORT_WORDS = 400_000
#: Suffixes that are refined together, at least; whole buckets only.
BLOCK = 1 << 16
NOBODY = -(2**63)


def _ranked(keys: np.ndarray, q: int) -> tuple[np.ndarray, int]:
    """The rank of each suffix's first elements among all such, in lexicographic order, and their number, at most q.

    What runs over the end counts as less than any element.
    """
    rank, have, n = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1, 1, len(keys)
    while have < q:
        bits = int(rank.max()).bit_length()
        step = have  # a rank tells `have` elements; as many ranks as fit a word are put side by side
        times = min(63 // bits, -(-q // have))
        if times < 2 or have * times > q:
            times, step = 2, min(have, q - have)  # the last two may overlap
        code = np.zeros(n, np.int64)
        for k in range(times):
            later = np.zeros(n, np.int64)
            later[: max(0, n - k * step)] = rank[k * step :]
            code = (code << bits) | later
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
        have += (times - 1) * step
    return rank, have


def refine(keys: np.ndarray, q: int, depth: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and bucket pointers of a sequence, to `depth` elements, by bucket-pointer refinement.

    keys: an int or uint64 for each element; suffixes are compared lexicographically, and one that ends
    sooner precedes. Buckets of q-grams are refined in turn, about `block` suffixes of whole buckets at a
    time: a bucket whose suffixes are known to share `known` elements is sorted by the pointers of the
    suffixes `known` on, its parts get pointers of their own at once, and parts that still aren't told
    apart are refined in the same way before the next buckets are. So what is sorted later reads pointers
    that have been refined already, and comes to `depth` in fewer steps: a part's suffixes share the
    `known` elements of the bucket that they were sorted by as well.

    Returns the suffix array and each suffix's pointer: the last place of its bucket. Suffixes share a
    pointer if their first `depth` elements are equal and both have that many.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, q = _ranked(keys, min(q, depth))
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    last = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True))
    sizes = np.diff(np.append(-1, last))
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(last, sizes)
    known = np.full(n, q, np.int64)  # by a bucket's last place: so many first elements its suffixes share

    def sort(places: np.ndarray) -> None:
        """Refine whole buckets, given by the places of their suffixes, to the end."""
        while len(places):
            suffixes = order[places]
            own = pointer[suffixes]
            later = suffixes + known[own]
            inside = later < n
            beyond = np.where(inside, pointer[np.minimum(later, n - 1)], n - 1 - later)
            by = np.lexsort((beyond, own))
            suffixes, own, beyond, inside = suffixes[by], own[by], beyond[by], inside[by]
            order[places] = suffixes
            ends = np.flatnonzero(np.append((own[1:] != own[:-1]) | (beyond[1:] != beyond[:-1]), True))
            size = np.diff(np.append(-1, ends))
            # those that run over the end are alone in their parts
            known[places[ends]] = known[own[ends]] + np.where(inside[ends], known[np.maximum(beyond[ends], 0)], depth)
            pointer[suffixes] = np.repeat(places[ends], size)
            open_ = np.repeat((size > 1) & (known[places[ends]] < depth), size)
            places = places[open_]

    wide = np.flatnonzero((sizes > 1) & (q < depth))
    done = 0
    while done < len(wide):
        total = np.cumsum(sizes[wide[done:]])
        some = wide[done : done + max(1, int(np.searchsorted(total, block, "right")))]
        sort(np.repeat(last[some] - sizes[some] + 1, sizes[some]) + _within(sizes[some]))
        done += len(some)
    return order, _at_depth(order, pointer, rank, q, depth)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _at_depth(order: np.ndarray, pointer: np.ndarray, rank: np.ndarray, q: int, depth: int) -> np.ndarray:
    """Pointers of buckets joined again that pointers refined beyond `depth` told apart: neighbours are compared by their q-grams."""
    n = len(order)
    left = np.flatnonzero(pointer[order[1:]] != pointer[order[:-1]])
    for at in [*range(0, depth - q, q), depth - q]:
        i, j = order[left] + at, order[left + 1] + at
        ok = (i < n) & (j < n)
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        left = left[ok]
    whole = order[left] + depth <= n
    left = left[whole & (order[left + 1] + depth <= n)]
    if not len(left):
        return pointer
    last = np.append(pointer[order[1:]] != pointer[order[:-1]], True)
    last[left] = False
    ends = np.flatnonzero(last)
    joined = np.empty(n, np.int64)
    joined[order] = np.repeat(ends, np.diff(np.append(-1, ends)))
    return joined


class _Runs:
    """The runs of windows of a chunk of texts that share a minimizer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int):
        self.words = w = Words(data, offsets)
        gram = min(ANCHOR, min_words)
        h = grams(w.hashes(), gram)
        n = len(w.starts) - min_words + 1  # windows of the chunk, those that cross rows included
        if n <= 0:
            self.hash, self.row, self.first, self.last = np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
            return
        key = (h & ~U64(0xFFFFFF)) | (np.arange(len(h), dtype=U64) & U64(0xFFFFFF))
        at = (sliding_min(key, min_words - gram + 1)[:n] & U64(0xFFFFFF)).astype(np.int64)
        at += (np.arange(n) - at + 0xFFFFFF) >> 24 << 24  # low bits of the place, at or after the window's start
        row = np.repeat(np.arange(len(w.counts)), w.counts)
        inside = row[:n] == row[min_words - 1 :]
        starts = np.flatnonzero(inside & np.append(True, (at[1:] != at[:-1]) | ~inside[:-1]))
        ends = np.flatnonzero(inside & np.append((at[1:] != at[:-1]) | ~inside[1:], True))
        self.hash, self.row, self.first, self.last = signed(h[at[starts]]), row[starts], starts, ends


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                r = _Runs(data[offsets[a] : offsets[b]], offsets[a : b + 1], min_words)
                at = r.first - r.words.of_row[r.row]
                yield pa.RecordBatch.from_pydict({"anchor": r.hash, "key": keys[a:b][r.row], "at": at.astype(np.int32)})

    return run


def _slices(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            wanted = batch.column("at").cast(pa.large_list(pa.int32()))
            where = np.asarray(wanted.offsets)
            values = np.asarray(wanted.values)
            for a, b in chunks(offsets):
                d = data[offsets[a] : offsets[b]]
                r = _Runs(d, offsets[a : b + 1], min_words)
                w = r.words
                at = r.first - w.of_row[r.row]
                mine = np.repeat(np.arange(b - a), np.diff(where[a : b + 1])) * (1 << 32) + values[where[a] : where[b]]
                keep = np.isin(r.row * (1 << 32) + at, mine)
                row, first, last = r.row[keep], r.first[keep], r.last[keep]
                if not len(row):
                    continue
                lo, hi = w.starts[first], w.ends[last + min_words - 1]
                ends = np.cumsum(hi - lo)
                take = np.repeat(lo - (ends - (hi - lo)), hi - lo) + np.arange(ends[-1])
                chars = char_positions(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r.hash[keep]),
                        batch.column("doc_id").slice(a, b - a).take(pa.array(row)),
                        batch.column("key").slice(a, b - a).take(pa.array(row)),
                        pa.array(at[keep].astype(np.int32)),
                        pa.array((chars[lo] - chars[w.offsets[row]]).astype(np.int32)),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(d[take])]).cast(pa.binary()),
                    ],
                    names=["anchor", "doc_id", "key", "at", "char", "slice"],
                )

    return run


def _spans(table: pa.Table, min_words: int) -> pa.RecordBatch:
    """Runs of repeated windows of whole buckets, apart by whether they are the first of their copies.

    Equal slices are sorted once: all windows of a slice that is there again are repeated, and of its
    occurrences only the first can have the first copy of a window.
    """
    table = table.combine_chunks()
    column = table.column("slice").combine_chunks()
    used, of = np.unique(column.indices.to_numpy(), return_inverse=True)
    distinct = column.dictionary.take(pa.array(used)).cast(pa.large_binary())
    doc = table.column("doc_id").combine_chunks()
    ids = doc.fill_null(NOBODY).to_numpy(zero_copy_only=False) if doc.null_count else doc.to_numpy()
    key, begin, char = table.column("key").to_numpy(), table.column("at").to_numpy().astype(np.int64), table.column("char").to_numpy().astype(np.int64)
    order = np.lexsort((begin, key, ids, of))
    head = np.append(True, of[order][1:] != of[order][:-1])[: len(of)]
    times_of = np.diff(np.append(np.flatnonzero(head), len(of)))
    lead, rest = order[head], order[~head]  # lead: the first occurrence of each distinct slice
    data, offsets = text_buffers(pa.LargeStringArray.from_buffers(len(distinct), distinct.buffers()[1], distinct.buffers()[2], None, 0, distinct.offset))
    w = Words(data, offsets)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    h = w.hashes()
    # a mark of its own between slices, so that no window reaches over an end
    place = np.arange(len(h)) + row
    keys = np.empty(len(h) + len(w.counts), U64)
    keys[place] = h
    marks = w.of_row[1:] + np.arange(len(w.counts))
    keys[marks] = U64(2**63) + np.arange(len(marks), dtype=U64) * U64(0x9E3779B97F4A7C15)
    _, pointer = refine(keys, min(9, min_words), min_words)
    # the same window can be in two slices only if it has the same anchor, so copies share a bucket here
    at = np.arange(len(h)) - w.of_row[row]
    window = np.flatnonzero(at <= w.counts[row] - min_words)
    p, r = pointer[place[window]], row[window]
    times = np.bincount(p, times_of[r], minlength=len(keys))[p].astype(np.int64)
    most = np.maximum.reduceat(times, np.flatnonzero(np.append(True, r[1:] != r[:-1]))) if len(r) else times
    window, p, r, times = window[times > 1], p[times > 1], r[times > 1], times[times > 1]
    word = begin[lead[r]] + at[window]
    by = np.lexsort((word, key[lead[r]], ids[lead[r]], p))
    first = np.zeros(len(p), bool)
    first[by[np.append(True, p[by][1:] != p[by][:-1])[: len(p)]]] = True
    new = np.append(True, (np.diff(window) != 1) | (np.diff(r) != 0) | (first[1:] != first[:-1]))[: len(window)]
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(window)) - 1 if len(starts) else starts
    chars = char_positions(data)
    rs, ws, we = r[starts], window[starts], window[stops] + min_words - 1
    base = chars[w.offsets[:-1]]
    # the other occurrences are repeated from end to end
    d = of[rest]
    size = chars[w.offsets[1:]] - base
    return pa.RecordBatch.from_arrays(
        [
            doc.take(pa.array(np.concatenate([lead[rs], rest]))),
            pa.array(np.concatenate([key[lead[rs]], key[rest]])),
            pa.array(np.concatenate([word[starts], begin[rest]]).astype(np.int32)),
            pa.array(np.concatenate([word[stops] + min_words, begin[rest] + w.counts[d]]).astype(np.int32)),
            pa.array(np.concatenate([char[lead[rs]] + chars[w.starts[ws]] - base[rs], char[rest]]).astype(np.int32)),
            pa.array(np.concatenate([char[lead[rs]] + chars[w.ends[we]] - base[rs], char[rest] + size[d]]).astype(np.int32)),
            pa.array(np.concatenate([np.maximum.reduceat(times, starts) if len(starts) else times, most[d]])),
            pa.array(np.concatenate([first[starts], np.zeros(len(rest), bool)])),
        ],
        names=["doc_id", "key", "start_word", "end_word", "start_char", "end_char", "n_copies", "keep"],
    )


def _sorted_buckets(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = last = 0
        for batch in batches:
            if not len(batch):
                continue
            column = batch.schema.get_field_index("slice")
            batch = batch.set_column(column, "slice", batch.column(column).dictionary_encode())
            held.append(batch)
            size += batch.nbytes
            if size < max(SORT_WORDS * 6, 2 * last):
                continue
            # equal slices of a bucket that goes on and on are held once
            table = pa.Table.from_batches(held).unify_dictionaries().combine_chunks()
            anchor = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last bucket may go on
            if whole:
                yield from _in_parts(table.slice(0, whole), min_words)
                table = _compact(table.slice(whole))
            held = table.to_batches()
            size = last = table.nbytes
        if held:
            yield from _in_parts(pa.Table.from_batches(held).unify_dictionaries().combine_chunks(), min_words)

    return run


def _compact(table: pa.Table) -> pa.Table:
    """A slice of a table with only the dictionary entries that it uses."""
    column = table.column("slice").combine_chunks()
    used, of = np.unique(column.indices.to_numpy(), return_inverse=True)
    own = pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int32)), column.dictionary.take(pa.array(used)))
    return table.set_column(table.schema.get_field_index("slice"), "slice", own).combine_chunks()


def _in_parts(table: pa.Table, min_words: int) -> Iterator[pa.RecordBatch]:
    anchor = table.column("anchor").to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
    column = table.column("slice").combine_chunks()
    lengths = pc.binary_length(column.dictionary).to_numpy()[column.indices.to_numpy()]
    total = np.append(0, np.cumsum(lengths.astype(np.int64)))[edges]
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(total, total[a] + SORT_WORDS * 6, "right")) - 1)
        yield _spans(table.slice(edges[a], edges[b] - edges[a]), min_words)
        a = b


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, start_char, end_char, n_words, n_copies, keep: a row for each span.

    Ends are exclusive. n_copies: the most copies that a window of the span has. keep: the span is of
    windows that are the first of their copies.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0").withColumn("key", F.xxhash64("text"))
    anchors = texts.select("key", "text").mapInArrow(_anchors(min_words), "anchor long, key long, at int")
    shared = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).filter("n > 1")
    wanted = shared.groupBy("key").agg(F.collect_set("at").alias("at"))
    slices = texts.join(wanted, "key").select("doc_id", "key", "text", "at").mapInArrow(_slices(min_words), "anchor long, doc_id long, key long, at int, char int, slice binary")
    runs = slices.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_buckets(min_words), "doc_id long, key long, start_word int, end_word int, start_char int, end_char int, n_copies long, keep boolean")
    of = Window.partitionBy("doc_id", "key", "keep").orderBy("start_word", "end_word")
    before = F.max("end_word").over(of.rowsBetween(Window.unboundedPreceding, -1))
    new: Column = F.when(before.isNull() | (F.col("start_word") > before), 1).otherwise(0)
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(of))
    spans = islands.groupBy("doc_id", "key", "keep", "island").agg(*[F.min(c).alias(c) for c in ("start_word", "start_char")], *[F.max(c).alias(c) for c in ("end_word", "end_char", "n_copies")])
    return spans.select("doc_id", "start_word", "end_word", "start_char", "end_char", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_copies", "keep")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
