"""Whole-batch text primitives: slices of Arrow strings as byte arrays, word spans and rolling hashes.

All functions work on the concatenated bytes of many texts, so the cost per text is small. Hashes are polynomials
modulo 2**64, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 21
_powers: dict[str, np.ndarray] = {}

#: Powers that a worker keeps from one task to the next.
KEPT_POWERS = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def give_back() -> None:
    """At the end of a task: return memory that is free but held, as Spark reuses Python workers for later stages."""
    if "up" in _powers and len(_powers["up"]) > KEPT_POWERS:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to return


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows: about `limit` bytes, at most `rows`; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n, low + rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of data[k] * BASE**k for i <= k < j."""
    up, _ = powers(len(data) + 1)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not ASCII white space."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = (data - np.uint8(9) > 4) & (data != 32)  # not in SPACES
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ink & edge[:-1]
    first[1:] |= ink[1:] & ~ink[:-1]
    last = ink & edge[1:]
    last[:-1] |= ink[:-1] & ~ink[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, rows = word_spans(data, offsets)
    return (span_hashes(prefix_sums(data), starts, ends), rows) if len(starts) else (np.zeros(0, np.uint64), rows)


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position (of the first word) of every run of n words inside one row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(total[at]), at


def joined_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space; every row must end with white space."""
    rows = len(offsets) - 1
    mark = np.zeros(len(data) + 1, np.int64)
    mark[starts[kept]] += 1
    mark[ends[kept] + 1] -= 1
    use = np.cumsum(mark[:-1]) > 0
    spaced = data.copy()
    spaced[ends] = 32
    at = np.flatnonzero(use)
    bounds = np.searchsorted(at, offsets)
    full = np.diff(bounds) > 0
    out = np.delete(spaced[at], bounds[1:][full] - 1)  # no space behind the last word
    bounds = np.append(0, np.cumsum(np.diff(bounds) - full))
    return pa.StringArray.from_buffers(rows, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def lower(texts: pa.Array) -> pa.Array:
    """Lower case, null as the empty text."""
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
