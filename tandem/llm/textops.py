"""Vectorised text helpers for Arrow batches (numpy over the raw UTF-8 buffer).

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, the class
``[^\\x20\\x09-\\x0D]+``: those six separators are ASCII, so no code point is cut.
Hashes are 64-bit; two different contents share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; temporary arrays are a few dozen times that.
SLICE_BYTES = 1 << 18
#: Rows of a batch that are worked on, and given out, at once.
RUN_ROWS = 256

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xD6E8FEB86659FD93)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, SLICE_BYTES + 1)
            self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, self.base, dtype=np.uint64)])
            self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, self.inverse, dtype=np.uint64)])
        return self.up[:n], self.down[:n]


_bytes_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i, independent of the position."""
    up, down = powers.get(len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _rolling(data.astype(np.uint64) + _U(1), starts, ends, _bytes_powers)


def window_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each start (word hashes in, sequence hashes out)."""
    return _rolling(words, starts, starts + k, _word_powers)


class Slice:
    """Some whole texts of one batch: bytes, and first byte of each text."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) byte of every word; index of the first word of every text (n + 1)."""
        return self.spans(SEPARATOR)

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = ~separators[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)  # a text begins here
        edge[self.offsets] = True
        before = np.r_[False, inside[:-1]] & ~edge[:-1] if len(inside) else inside
        after = np.r_[inside[1:], False] & ~edge[1:] if len(inside) else inside
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def row_runs(batches: Iterable[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows, none copied: what is made of a run goes out before the next one,
    so that neither a worker nor its executor holds a second batch of Spark's size."""
    rows = rows or RUN_ROWS
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slices(texts: pa.Array, limit: int = SLICE_BYTES, lower: bool = False) -> Iterator[Slice]:
    """Cut a batch's texts into runs of whole texts of about ``limit`` bytes.

    A null text counts as empty. Temporary arrays are a few dozen times a run,
    so memory follows the longest single text, not the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[texts.offset:texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        part = data[offsets[lo]:offsets[hi]]
        yield Slice(lo, hi, LOWER[part] if lower else part, offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def distinct_sets(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's tokens sorted and distinct, with the first one of each text (and the end).
    Each text is sorted on its own, in place: far faster than one sort by (text, token)."""
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        tokens[lo:hi].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[first[:-1][first[:-1] < len(tokens)]] = True
    return tokens[new], np.r_[0, np.cumsum(new)][first]


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text of every word, from the first-word index of every text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i:i + width] for every i with a full window."""
    if len(keys) < width:
        return keys[:0]
    reach, low = 1, keys
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Arrow binary array: row i holds the bytes of values[cuts[i]:cuts[i + 1]]."""
    offsets = (np.asarray(cuts, dtype=np.int64) * values.dtype.itemsize)
    if offsets[-1] >= 1 << 31:
        raise ValueError("batch too large for 32-bit offsets")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
