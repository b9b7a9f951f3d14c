"""Vectorised text primitives shared by the corpus operators.

A batch of texts is one UTF-8 buffer plus offsets, exactly as Arrow delivers it.  Words are maximal runs of ASCII
letters, digits and non-ASCII bytes; everything else separates.  ASCII and Latin-1 letters are folded to lower case.
All steps are whole-buffer numpy operations, so the cost is a few nanoseconds per byte and never a Python loop per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass; bounds a Python worker's memory whatever Arrow's batch size is.
CHUNK_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers[name] = have = out
    return have[:n]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty.  offsets[0] is 0."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: a worker that is kept for later tasks would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Cuts a record batch into row ranges of at most `limit` bytes of text (a longer single text is alone)."""
    at = batch.schema.get_field_index(column)
    _, offsets = buffers(batch.column(at))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 letters; lengths never change."""
    low = _FOLD[raw]
    if len(raw) > 1:
        after = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][after] += 32
    return low


class Words:
    """Word spans and 64-bit hashes of a batch of texts."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = buffers(column)
        self.raw = raw
        n = len(raw)
        self.n_docs = len(self.offsets) - 1
        inside = _WORD[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: words of document d: first[d] .. first[d + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((fold(raw).astype(np.uint64) + np.uint64(1)) * _power(_B, "b", n), out=sums[1:])
            self.hash = mix64((sums[self.end] - sums[self.start]) * _power(_BINV, "i", n + 1)[self.start])
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of w words that lies in one document."""
        n = len(self) - w + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[w - 1 :]) if w > 1 else np.arange(n)
        with np.errstate(over="ignore"):
            acc = self.hash[at]
            for j in range(1, w):
                acc = acc * _SHINGLE + self.hash[at + j]
        return mix64(acc), at


def char_index(raw: np.ndarray) -> np.ndarray:
    """For every byte position (and the end) the number of code points before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)
