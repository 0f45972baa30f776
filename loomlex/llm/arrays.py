"""Numpy views of Arrow text columns: words, rolling hashes, window minimisers.

Everything works on one chunk of whole texts at a time (``text_chunks``), so
memory is bounded by the chunk size or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_MULT = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)

# One 64-bit value per byte value, from a fixed seed: the same in every worker.
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def giving_back(run):
    """``run`` of mapInArrow that returns freed memory to the system after its last
    batch: Spark reuses Python workers, which else keep it for as long as they live."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
    return wrapped


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, byte offsets from 0, bytes) of whole texts.

    A chunk holds at least one text and at most ``max_bytes`` unless a single
    text is longer.  Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offs, offs[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, offs[row:end + 1] - offs[row], data[offs[row]:offs[end]]
        row = end


def joined_bytes(column: pa.Array) -> bytes:
    """All values of a binary column without nulls, end to end."""
    raw = column.buffers()[2]
    if raw is None or not len(column):
        return b""
    offs = np.frombuffer(column.buffers()[1], dtype=np.int32)
    return raw[int(offs[column.offset]):int(offs[column.offset + len(column)])].to_pybytes()


KEY_BYTES = 16


def key_values(column: pa.Array) -> np.ndarray:
    """A binary column of row keys as numpy values that can be indexed and joined."""
    return np.frombuffer(joined_bytes(column), f"V{KEY_BYTES}")


def key_column(values: np.ndarray) -> pa.Array:
    """The reverse of ``key_values``."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * KEY_BYTES
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def key_longs(values: np.ndarray) -> np.ndarray:
    """The first 64 bits of row keys, to deal rows by."""
    return np.frombuffer(values.tobytes(), np.int64)[::KEY_BYTES // 8]


def byte_class(chars: bytes) -> np.ndarray:
    """Boolean table over byte values."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


BLANK = byte_class(b" \t\n\x0b\x0c\r")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANK):
    """(starts, ends, first): byte spans of the words (maximal runs without a
    separator, never across texts) and, per text, the index of its first word
    (one more entry than texts)."""
    word = ~separator[data]
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[edges - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(values: np.ndarray, base: int = _MULT) -> np.ndarray:
    """Prefix sums (from 0) of values[i] * base**i, for ``span_hash``."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts, ends, inverse: int = _INV) -> np.ndarray:
    """Position-free 64-bit hash of each span [start, end)."""
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(sums))[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return span_hash(prefix_sums(_BYTE_VALUES[data]), starts, ends)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values (len(values) - n + 1 of them, at least none)."""
    count = max(len(values) - n + 1, 0)
    sums = prefix_sums(values)
    return mix((sums[n:n + count] - sums[:count]) * powers(_INV, len(sums))[:count])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def window_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Positions at which a window of ``window`` items fits inside its text, for
    texts of the given lengths laid end to end."""
    total = int(lengths.sum())
    ok = np.ones(total, dtype=bool)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # the last window - 1 positions of every text, all of a short text
    tail = np.maximum(ends - (window - 1), starts)
    delta = np.zeros(total + 1, dtype=np.int64)
    np.add.at(delta, tail, 1)
    np.add.at(delta, ends, -1)
    ok &= np.cumsum(delta[:-1]) == 0
    return np.flatnonzero(ok)


_PLACE_BITS = np.uint64(24)


def minimiser(grams: np.ndarray, span: int) -> np.ndarray:
    """For each i: position of the smallest of grams[i:i+span], leftmost on ties.

    The choice depends only on the contents of the span (the upper 40 bits of its
    hashes), so equal windows pick the same relative position wherever they stand.
    """
    n = len(grams)
    if n < span:
        return np.zeros(0, dtype=np.int64)
    part = (1 << 23) + span
    if n > part:  # very long texts, in overlapping parts
        return np.concatenate([lo + minimiser(grams[lo:lo + part], span)
                               for lo in range(0, n - span + 1, part - span + 1)])
    packed = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if width < span:
        shift = span - width
        packed = np.minimum(packed[:-shift], packed[shift:])
    return (packed & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merge_spans(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Boolean cover of [0, length) by the spans."""
    delta = np.zeros(length + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
