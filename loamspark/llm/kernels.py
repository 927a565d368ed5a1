"""Vectorised byte and word kernels over Arrow string columns.

A batch is cut into chunks of whole rows of about CHUNK_BYTES, so that the temporaries of a
kernel stay at a few dozen MB however large an Arrow batch is; a longer single text is a chunk
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)

        def series(b: int) -> np.ndarray:
            out = np.ones(size, U64)
            done, step = 1, b
            while done < size:
                m = min(done, size - done)
                out[done : done + m] = out[:m] * U64(step)
                done, step = done + m, step * step % 2**64
            return out

        have = _POWERS[base] = (series(base), series(pow(base, -1, 2**64)))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits of h."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 row offsets; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, covering all rows."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The white-space separated words of a chunk of texts: byte ranges, hashes and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        n = len(data)
        space = data <= 32
        first = np.ones(n + 1, bool)
        first[1:n] = space[:-1]
        first[self.offsets] = True
        starts = np.flatnonzero(first[:n] & ~space) if n else np.zeros(0, np.int64)
        stop = np.zeros(n + 1, bool)
        stop[:n] = space
        stop[self.offsets] = True
        # the first stop after each start
        stops = np.flatnonzero(stop)
        self.starts = starts
        self.ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
        self.of_row = np.searchsorted(starts, self.offsets)  # words of row r: of_row[r] .. of_row[r + 1]
        self.counts = np.diff(self.of_row)

    def hashes(self, data: np.ndarray | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (or of the given ranges of the given bytes)."""
        data = self.data if data is None else data
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        up, down = powers(_BASE, len(data) + 1)
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts])


def grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q consecutive elements: n - q + 1 of them."""
    n = len(hashes)
    if n < q:
        return np.zeros(0, U64)
    up, down = powers(_WORD_BASE, n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=prefix[1:])
    return mix((prefix[q:] - prefix[:-q]) * down[: n - q + 1])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: n - w + 1 of them, in log2(w) passes."""
    if len(values) < w:
        return values[:0]
    have, size = values, 1
    while size * 2 <= w:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    rest = w - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def char_positions(data: np.ndarray) -> np.ndarray:
    """Characters before each byte position of UTF-8 text, n + 1 of them."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
