"""Vectorised word, line and hash helpers over Arrow string arrays.

All functions work on the UTF-8 bytes of a group of texts laid end to end, so
that one numpy call handles thousands of texts.  Words are maximal runs of
bytes outside ``[\\x20\\x09-\\x0D]``; they never cross a text's end.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that continue a UTF-8 sequence, so that the others count code points.
CONT = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Byte values of window hashes.
FIRST = np.random.default_rng(20240302).integers(0, 2**64, 256, dtype=np.uint64)
#: A second table, for hashes that don't clash where those of the first do.
SECOND = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


_libc = ctypes.CDLL(ctypes.util.find_library("c") or None)


def trim() -> None:
    """Gives freed memory back to the system, so that a reused worker doesn't keep what its largest group took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_kept: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a Python worker keeps between tasks for one operator; what it kept for another goes first."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = {}
    return _kept[name]


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(1 << (n - 1).bit_length(), 1024), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes (one text at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int, int, int]]:
    """Ranges i, j of whole texts and of their bytes, of about `limit` bytes; a longer text alone (j = i + 1) comes in several, each cut before white space (a word is never cut)."""
    for i, j in groups(offsets, limit):
        lo, end = int(offsets[i]), int(offsets[j])
        if end - lo <= 2 * limit:
            yield i, j, lo, end
            continue
        while lo < end:
            hi = min(lo + limit, end)
            while hi < end:
                gap = np.flatnonzero(WS[data[hi : min(hi + 4096, end)]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(hi + 4096, end)
            yield i, j, lo, hi
            lo = hi


class Words:
    """Words of a group of texts: starts, ends (byte positions), text number, and words per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
        """cuts: a mask of bytes inside words before which a word is cut in two."""
        self.data, self.offsets = data, offsets
        inside = ~WS[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if cuts is not None and len(cuts):
            first |= cuts
            last[:-1] |= cuts[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[edge] = inside[edge]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words, and the texts' bounds among them; a long text is read in pieces."""
    counts, out = np.zeros(len(offsets) - 1, np.int64), []
    for i, j, lo, hi in pieces(data, offsets):
        words = Words(LOWER[data[lo:hi]], offsets[i : j + 1] - lo if hi - lo == offsets[j] - offsets[i] else np.array([0, hi - lo]))
        counts[i:j] += words.counts
        out.append(words.hashes())
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


#: Bytes of spans that are hashed at once.
SPAN_BYTES = 1 << 22


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and are in order; empty spans hash to one value."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        before = int(total[i] - lengths[i])
        j = max(i + 1, int(np.searchsorted(total, before + SPAN_BYTES, "right")))
        if lengths[i] > SPAN_BYTES:
            out[i] = np.concatenate([_span_sums(data, starts[i : i + 1] + k, np.minimum(lengths[i : i + 1] - k, SPAN_BYTES)) * np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(0, int(lengths[i]), SPAN_BYTES)]).sum()
            j = i + 1
        else:
            out[i:j] = _span_sums(data, starts[i:j], lengths[i:j])
        i = j
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _span_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the base."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        n = lengths[full]
        first = np.cumsum(n) - n
        local = np.arange(int(n.sum())) - np.repeat(first, n)
        values = _RANDOM[data[np.repeat(starts[full], n) + local]] * powers(int(n.max()))[local]
        out[full] = np.add.reduceat(values, first)
    return out


_INVERSE = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """The first n powers of the hash base's inverse, modulo 2**64."""
    global _INVERSE
    if len(_INVERSE) < n:
        p = np.full(max(1 << (n - 1).bit_length(), 1024), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        p[0] = 1
        _INVERSE = np.multiply.accumulate(p)
    return _INVERSE[:n]


def word_span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 1 << 15, limit: int = 1 << 20) -> np.ndarray:
    """The same as span_hashes, from prefix sums of all bytes between the spans: faster where spans take up most of them."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), words):
        part = slice(i, i + words)
        lo, hi = int(starts[i]), int(ends[part][-1])
        if hi - lo > limit:
            out[part] = span_hashes(data, starts[part], ends[part])
            continue
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_RANDOM[data[lo:hi]] * powers(hi - lo), out=sums[1:])
        a, b = starts[part] - lo, ends[part] - lo
        out[part] = mix((sums[b] - sums[a]) * inverse_powers(hi - lo)[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


class Rolling:
    """Hashes of spans of one width anywhere in a byte array, from prefix sums modulo 2**64; equal spans of any arrays hash alike."""

    def __init__(self, data: np.ndarray, values: np.ndarray = FIRST):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers(n), out=self.sums[1:])
        self.back = inverse_powers(n + 1)

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the spans [at, at + width)."""
        return mix((self.sums[at + width] - self.sums[at]) * self.back[at])


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items, for each start that has n items."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(0, len(out), 1 << 20):
        part = out[i : i + (1 << 20)]
        for k in range(1, n):
            part = mix(part * _BASE + hashes[i + k : i + k + len(part)])
        out[i : i + len(part)] = part
    return out


def batches(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about `limit` bytes of text, with their bytes and offsets."""
    data, offsets = as_bytes(batch.column(batch.schema.get_field_index(column)))
    for i, j in groups(offsets, limit):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    trim()
