"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; A-Z is
lower-cased.  Every byte of that class is ASCII, so working on UTF-8 bytes gives
the same words as working on code points.  Hashes are 64 bits wide and depend on
the words alone, so they agree between tasks, runs and machines.

Nulls count as empty texts.  No text is cut: a slice holds whole texts, and a
text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

SLICE_BYTES = 1 << 20
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1 of them) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and words before each row (n + 1 of them)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z lower-cased."""
    return _LOWER[raw]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """Each word's 64-bit hash: eight bytes a step through a finaliser for words of up to LONG_WORD bytes, xxh3 for longer ones.

    Words of up to eight bytes and equal length never collide, others by chance, 2**-64 a pair.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    text = np.concatenate((lower_bytes(raw) if lower else raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", text, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if not len(live):
            break
        left = size[live] - at
        out[live] = mix(out[live] ^ (eight[start[live] + at] & _FIRST[np.minimum(left, 8)]) + np.uint64(at))
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]], 7)
    return out


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one text, ascending; fewer words than ``size`` make one shingle."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - width + 1 + j]
    return np.unique(mix(total + np.uint64(width)))


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed plane by plane of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
