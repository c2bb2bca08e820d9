"""Vectorised word and shingle hashing over Arrow string columns.

Text stays in Arrow's UTF-8 buffer: words are found with byte masks and hashed
eight bytes at a time, so no Python string is made for a word. Hashes are 64-bit
and keyed; equality of words and shingles below means equality of these hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time, unless one text is longer.
SLICE_BYTES = 1 << 18
#: Spans that begin in so many bytes are hashed together. Longer spans than LONG bytes are hashed each by itself.
WINDOW, LONG = 1 << 20, 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offset of each text. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most this many bytes together; a longer text is alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without white space, and the number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    left = np.empty(n, bool)
    left[0], left[1:] = True, ~inside[:-1]
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (left | cut[:n]))
    ends = np.flatnonzero(inside & (right | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, little end first; zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    for shift in (1, 2, 4):
        padded[:-shift] |= padded[shift:] << np.uint64(8 * shift)
    return padded[: len(data)]


def _windows(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """For ranges of spans: first and last span, the first byte of the range, and its eights up to LONG bytes after the last start."""
    a = 0
    while a < len(starts):
        at = int(starts[a])
        b = int(np.searchsorted(starts, at + WINDOW, side="left"))
        yield a, b, at, _eights(data[at : int(starts[b - 1]) + LONG + 8])
        a = b


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, key: int = 0) -> np.ndarray:
    """A hash of the bytes of each span under the key, A-Z taken as a-z if lower; starts ascend.

    Up to LONG bytes are mixed eight at a time, longer spans by a keyed cryptographic
    hash. With a key that nobody could know, no text can be made to collide.
    """
    secret = hashlib.blake2b(key.to_bytes(8, "little"), digest_size=16, person=b"span").digest()
    first, later = (np.uint64(int.from_bytes(secret[i : i + 8], "little")) for i in (0, 8))
    size = (ends - starts).astype(np.int64)
    out = mix(first ^ (size.astype(np.uint64) * _STEP[0]))
    for a, b, at, eights in _windows(LOWER[data] if lower else data, starts):
        alive, j = np.arange(a, b), 0
        alive = alive[size[a:b] <= LONG]
        while len(alive := alive[size[alive] > j]):
            block = eights[starts[alive] - at + j] & _LOW_BYTES[np.minimum(size[alive] - j, 8)]
            out[alive] = mix((out[alive] + later) ^ block) + block * _STEP[1]
            j += 8
    for i in np.flatnonzero(size > LONG).tolist():
        raw = data[starts[i] : ends[i]]
        raw = (LOWER[raw] if lower else raw).tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=secret).digest(), "little")
    return mix(out)


def short_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans of up to seven bytes as numbers: the bytes themselves and how many they are. Of longer spans the first seven bytes."""
    size, out = (ends - starts).astype(np.int64), np.zeros(len(starts), np.uint64)
    for a, b, at, eights in _windows(data, starts):
        n = np.minimum(size[a:b], 7)
        out[a:b] = (eights[starts[a:b] - at] & _LOW_BYTES[n]) | n.astype(np.uint64) << np.uint64(56)
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[starts:starts + size] and other[at:at + size] are the same bytes."""
    out, alive, j = np.ones(len(starts), bool), np.arange(len(starts)), 0
    while len(alive := alive[out[alive] & (size[alive] > j)]):
        out[alive] = data[starts[alive] + j] == other[at[alive] + j]
        j += 1
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    n = len(hashes)
    run = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        run += hashes[j : n - k + 1 + j] * _STEP[j] if len(run) else 0
    run = mix(run)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            yield mix((hashes[a:b] * _STEP[k : k + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield run[:0]


def shingle_sets(column: pa.Array, k: int, key: int = 0) -> Iterator[np.ndarray]:
    data, off = flat(column)
    for a, b in slices(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = words(part, at)
        yield from shingles(span_hashes(part, starts, ends, key=key), first, k)
