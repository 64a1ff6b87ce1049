"""Whole columns of text as byte arrays: word positions and word hashes without a loop.

A batch of an Arrow string column is one byte buffer with offsets. Words are runs of bytes
of a class given by a table of 256 flags; since all classes used here keep every byte from
0x80 up as part of a word, cutting bytes and cutting characters give the same words.
NULL texts have no bytes.
"""

import ctypes
import ctypes.util
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text handled at once; one longer text is a slice of its own

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def byte_table(separators: str) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Words of the contracts: runs without white space, and runs of ASCII letters, digits and
#: characters beyond ASCII.
NOT_SPACE = byte_table(" \t\n\x0b\x0c\r")
ALPHANUMERIC = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        factors = np.full(1 << n.bit_length(), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[name] = np.multiply.accumulate(factors)
    return have[:n]


def release() -> None:
    """Give back to the system what this process's allocators keep."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what the worker still holds after the last one is given back to the system.

    Spark keeps a Python worker for later tasks, and with it all memory that its allocators keep."""
    try:
        yield from batches
    finally:
        release()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of some texts: ``start``/``end`` are byte places in ``data``; the words of text i
    are those from ``first[i]`` up to ``first[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.data, self.start, self.end)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow array."""
        return spans_as_binary(self.data, self.start[which], self.end[which]).cast(pa.string())


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, from one running sum over all bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power(_MULTIPLIER, len(data), "up"), out=sums[1:])
    back = _power(_INVERSE, len(data) + 1, "down")
    raw = (sums[end] - sums[start]) * back[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans_as_binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte spans copied into one Arrow binary array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    places = np.arange(offsets[-1], dtype=np.int64) + np.repeat(start - offsets[:-1], size)
    packed = np.ascontiguousarray(data[places])
    return pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    )


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, so that memory stays bounded."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def find_words(column: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """All words of a column; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_buffers(column)
    if lower:
        data = _LOWER[data]
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the place of the first
    window of each text. A text of fewer words, but not none, is one window."""
    counts = np.diff(first)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.zeros(len(windows) + 1, dtype=np.int64)
    np.cumsum(windows, out=at[1:])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], windows)
    length = np.repeat(np.minimum(counts, size), windows)
    total = np.zeros(len(begin), dtype=np.uint64)
    padded = np.append(hashes, np.zeros(size, dtype=np.uint64))
    for j in range(size):
        term = padded[begin + j] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
        total += np.where(j < length, term, np.uint64(0))
    return mix(total + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), at
