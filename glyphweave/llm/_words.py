"""Words and word windows of whole batches of texts, as numpy arrays.

A batch of texts is one byte buffer with offsets. Word borders come from one table lookup per byte; a word's
64-bit hash is a polynomial over per-byte random values, so no Python object is made per word. Windows of k
words are hashed in the same way over the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BYTE_ROOT, _WORD_ROOT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

ASCII_LOWER = bytes(range(256)).lower()
#: Separators: white space alone, or all ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
#: Powers of each root that a worker keeps; those of longer texts are made anew.
_KEPT = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(root: int, n: int) -> np.ndarray:
    """root ** 0 .. root ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(root)
    if have is None or len(have) < n:
        have = np.full(max(n, _KEPT), root, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= _KEPT:
            _powers[root] = have
    return have[:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int, of: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start:end], or of values[of[start:end]], for each span; equal spans have equal hashes wherever they stand.

    starts and ends ascend."""
    # In pieces of about _KEPT values, as the arrays of a piece stay in the processor's cache; a span longer than that makes its piece longer.
    inverse, out, at = pow(root, -1, 1 << 64), np.empty(len(starts), U64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _KEPT - 1, "right")))
        n = int(ends[to - 1]) - low
        total = np.zeros(n + 1, U64)
        np.cumsum((values[low : low + n] if of is None else values[of[low : low + n]]) * _power(root, n), out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[b] - total[a]) * _power(inverse, n + 1)[a]
        at = to
    return mix(out)


class Texts:
    """The words of a batch of texts. first[d]:first[d + 1] are the words of text d."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, lower: bool = True):
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = (data.to_pybytes() if data is not None and offsets[-1] - offsets[0] == data.size else bytes(memoryview(data)[offsets[0] : offsets[-1]])) if data is not None else b""
        self.raw = raw.translate(ASCII_LOWER) if lower else raw
        self.offsets = offsets - offsets[0]
        buffer = np.frombuffer(self.raw, np.uint8)
        inside = ~separators[buffer]
        new = np.zeros(len(buffer) + 1, bool)
        new[self.offsets] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(buffer):
            before[0], before[1:] = True, ~inside[:-1]
            after[-1], after[:-1] = True, ~inside[1:]
            before |= new[:-1]
            after |= new[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._buffer = buffer

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return _spans(_BYTE_VALUES, self.starts, self.ends, _BYTE_ROOT, self._buffer)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]


def windows(words: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each window of k words and first[d]:first[d + 1] of those of text d.

    short: a text of fewer than k words, but one at least, has its whole sequence as its only window."""
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    if short:
        n = np.where((n == 0) & (counts > 0), 1, n)
    of = np.concatenate([[0], np.cumsum(n)])
    starts = np.arange(of[-1]) + np.repeat(first[:-1] - of[:-1], n)
    ends = np.minimum(starts + k, np.repeat(first[1:], n))
    return _spans(words, starts, ends, _WORD_ROOT) ^ U64(k), of


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
