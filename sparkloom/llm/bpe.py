"""Byte-level BPE by ranks: whole texts to ids and ids back to bytes.

A long text is cut into overlapping chunks that become rows of their own, so its
chunks are pre-tokenised and encoded by as many tasks. A chunk is read as if a text
began there, so its first pieces may be wrong; but what follows a border of two
pieces does not depend on what is before it, so from the first border that a chunk
and the one before it both have, in their overlap, the two agree. There they are
stitched. The overlap reaches over the first end of a word behind the next chunk's
start: a printable ASCII byte before white space is always such a border.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from . import tokenizer as K

#: Bytes from the start of a chunk to that of the next. Texts of up to so many bytes are one chunk.
CHUNK = 1 << 15
#: A border is sure where so many bytes of the chunk follow: one character, of which a piece may depend.
SURE = 4
#: Pieces of more bytes are merged one by one with a heap, shorter ones all together, those of one length as the rows of a matrix.
SHORT = 40
#: Slots of the table of pairs, as a power of two, for each pair at least.
ROOM = 4
NONE = np.int32(2**31 - 1)
#: Ids kept before the table of pieces is dropped and built again.
MOST_IDS = 4_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ranks:
    """A vocabulary of ranked byte strings, and the ids of the pieces seen so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.rank.items():
            self.bytes[i] = token
        self.size = np.fromiter(map(len, self.bytes), np.int64, size)
        self.flat, self.at = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.size) - self.size
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self._pair_table()
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids, self.used = K.PieceCache(), np.zeros(1 << 16, np.int32), 0

    def _pair_table(self) -> None:
        """The pairs of tokens that together are a token, and its rank, in an open hash table."""
        rank = self.rank
        pairs = [(x, y, r) for token, r in rank.items() for i in range(1, len(token)) if (x := rank.get(token[:i])) is not None and (y := rank.get(token[i:])) is not None]
        left, right, value = (np.array(x, np.int64) for x in zip(*pairs))
        self.mask = (1 << (ROOM * len(pairs)).bit_length()) - 1
        self.pair_key, self.pair_rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        key, at = left << 32 | right, self._slot(left, right)
        while len(key):
            free = self.pair_key[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.pair_key[at[taken]], self.pair_rank[at[taken]] = key[taken], value[taken]
            rest = np.ones(len(key), bool)
            rest[taken] = False
            key, value, at = key[rest], value[rest], at[rest] + 1 & self.mask

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 0x9E3779B1 ^ right * 0x85EBCA6B) >> 7 & self.mask

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where it is no token."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        key, at = (left << 32 | right).ravel(), self._slot(left, right).ravel()
        out, open_ = self.pair_rank[at], np.flatnonzero((self.pair_key[at] != key) & (self.pair_key[at] >= 0))
        out[self.pair_key[at] < 0] = NONE
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            held = self.pair_key[at[open_]]
            out[open_] = np.where(held == key[open_], self.pair_rank[at[open_]], NONE)
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return out.reshape(left.shape)

    def merged_rows(self, data: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of pieces of one length: rows, and a matrix with what these are merged to. In every step each row that is left joins its pair of least rank, the first of equal ones."""
        ids, rows, out = self.byte[data[starts[:, None] + np.arange(length)]], np.arange(len(starts)), []
        rank = self._pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n, parts = ids.shape
            if parts == 1:
                out.append((rows, ids))
                break
            best = rank.argmin(axis=1)
            least = rank[np.arange(n), best]
            done = least == NONE
            if done.any():
                out.append((rows[done], ids[done]))
                rows, ids, rank, best, least = rows[~done], ids[~done], rank[~done], best[~done], least[~done]
                n = len(rows)
                if not n:
                    break
            line = np.arange(n)
            ids[line, best] = least
            keep = np.ones((n, parts), bool)
            keep[line, best + 1] = False
            ids = ids[keep].reshape(n, parts - 1)
            keep = np.ones((n, parts - 1), bool)
            keep[line, best] = False
            rank = rank[keep].reshape(n, parts - 2)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < parts - 2)
            rank[left, best[left] - 1] = self._pairs(ids[left, best[left] - 1], ids[left, best[left]])
            rank[right, best[right]] = self._pairs(ids[right, best[right]], ids[right, best[right] + 1])
        return out

    def merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has. A piece that is a token is that token."""
        whole = np.fromiter((self.rank.get(data[a : a + n].tobytes(), -1) for a, n in zip(starts.tolist(), size.tolist())), np.int64, len(starts))
        count, found = np.ones(len(starts), np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0][:, None])]
        for length in np.unique(size[(whole < 0) & (size <= SHORT)]).tolist():
            mine = np.flatnonzero((whole < 0) & (size == length))
            found += [(mine[rows], ids) for rows, ids in self.merged_rows(data, starts[mine], length)]
        for i in np.flatnonzero((whole < 0) & (size > SHORT)).tolist():
            found.append((np.array([i]), np.array([self._merged_long(data[starts[i] : starts[i] + size[i]].tobytes())])))
        for rows, ids in found:
            count[rows] = ids.shape[1]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, ids in found:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, count

    def _merged_long(self, piece: bytes) -> list[int]:
        """The ids of one piece, with its pairs in a heap: as long as n log n for n bytes."""
        rank, n = self.rank, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte; where the part before it starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n

        def pair(a: int) -> None:
            b = end[a]
            if b < n and (r := rank.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))

        while heap:
            _, a, stop = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or end[end[a]] != stop or end[a] == stop:
                continue
            b = end[a]
            alive[b], end[a] = False, stop
            if stop < n:
                before[stop] = a
            pair(a)
            if before[a] >= 0:
                pair(before[a])
        return [rank[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _learn(self, found: K.Pieces, new: np.ndarray) -> np.ndarray:
        """Where the ids of the pieces new begin, and how many they are, as one number a piece."""
        ids, sizes = self.merged(found.data, found.starts[new], found.size[new])
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        value = (self.used + np.cumsum(sizes) - sizes) << 30 | sizes
        self.used += total
        self.known.add(found, new, value)
        return value

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts end to end: all ids, the first byte and the first id of each piece, and the first piece of each text (one more at the end of the last two)."""
        starts, _, first = K.pieces(data, off)
        found = K.Pieces(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        if self.used > MOST_IDS or len(self.known.keys) + len(found.keys) > K.PieceCache.MOST:
            self._clear()
        value, hit = self.known.find(found)
        new = np.flatnonzero(~hit)
        if len(new):
            value[new] = self._learn(found, new)
        value = value[found.back]
        at, size = value >> 30, value & (1 << 30) - 1
        sums = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(sums[-1]) + np.repeat(at - sums[:-1], size)], starts, sums, first

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids end to end, and the first byte of each id, with one more."""
        size = self.size[ids]
        sums = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(sums[-1]) + np.repeat(self.at[ids] - sums[:-1], size)], sums


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def cuts(data: np.ndarray, chunk: int) -> list[tuple[int, int, int]]:
    """(start, next start, end) of the chunks of a text; a chunk overlaps the next from next start to end, the last has none.

    Chunks overlap two at most, so all of them together have at most twice the text.
    """
    n, out, start = len(data), [], 0
    space = T.SPACE[data]
    ends = np.flatnonzero((data[:-1] > 0x20) & (data[:-1] < 0x7F) & space[1:]) + 1
    last = 0  # end of the chunk before
    while True:
        following = max(start + chunk, last)
        while following < n and data[following] & 0xC0 == 0x80:
            following += 1
        at = int(np.searchsorted(ends, following + 1))
        end = int(ends[at]) + SURE if at < len(ends) else n
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        if following >= n or end >= n:
            out.append((start, n, n))
            return out
        out.append((start, following, end))
        start, last = following, end


_CHUNK = "at long, doc_id {0}, place int, start long, head long, tail long, chunk binary"
_PART = "at long, doc_id {0}, place int, ids array<int>, heads array<long>, head_ids array<int>, tails array<long>, tail_ids array<int>"


def _cutter(chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.flat(batch.column(2))
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                text, end = data[a:b], 0
                found = cuts(text, chunk)
                for place, (start, following, stop) in enumerate(found):
                    row = [[start], [end - start if place else 0], [following - start], [text[start:stop].tobytes()]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([place], pa.int32()), *(pa.array(x, pa.int64()) for x in row[:3]), pa.array(row[3], pa.binary())], ["at", "doc_id", "place", "start", "head", "tail", "chunk"])
                    end = stop

    return cut


def _lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def _parts(path: str):
    """Encodes chunks; of each also the borders in its two overlaps, as places in the text, and the ids before them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, head, tail = (batch.column(k).to_numpy() for k in (3, 4, 5))
            chunks = batch.column(6).to_pylist()
            off = np.concatenate([[0], np.cumsum([len(x) for x in chunks])]).astype(np.int64)
            for a, b in T.slices(off):
                data, at = np.frombuffer(b"".join(chunks[a:b]), np.uint8), off[a : b + 1] - off[a]
                ids, starts, sums, first = ranks(path).encode(data, at)
                for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    place, before = starts[p:q] - at[i], (sums[p:q] - sums[p]).astype(np.int32)
                    h, t = place <= head[a + i] - SURE, (place >= tail[a + i]) & (place <= at[i + 1] - at[i] - SURE)
                    each = [(ids[sums[p] : sums[q]], pa.int32()), (place[h] + start[a + i], pa.int64()), (before[h], pa.int32()), (place[t] + start[a + i], pa.int64()), (before[t], pa.int32())]
                    lists = [_lists(x, np.array([0, len(x)]), kind) for x, kind in each]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a + i, 1) for k in range(3)), *lists], ["at", "doc_id", "place", "ids", "heads", "head_ids", "tails", "tail_ids"])

    return encode


def _stitched(chunks: pd.DataFrame) -> pd.DataFrame:
    """The ids of one text from those of its chunks."""
    chunks = chunks.sort_values("place")
    out, begin, rows = [], 0, list(chunks.itertuples())
    for here, after in zip(rows, rows[1:]):
        _, x, y = np.intersect1d(here.tails, after.heads, return_indices=True)
        if not len(x):
            raise ValueError("two chunks without a common border")
        out.append(here.ids[begin : here.tail_ids[x[0]]])
        begin = after.head_ids[y[0]]
    out.append(rows[-1].ids[begin:])
    return pd.DataFrame({"doc_id": [rows[0].doc_id], "ids": [np.concatenate(out)]})


def _whole(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.flat(batch.column(1))
            for a, b in T.slices(off):
                ids, _, sums, first = ranks(path).encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(ids, sums[first])], ["doc_id", "ids"])

    return encode


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) for each row of docs, as the library for rank files has it, special strings as ordinary text.

    A null or empty text has no ids. Repeated rows stay, a doc_id may be null; texts of any
    length are read whole, long ones by many tasks (the ids of one text are one value at the
    end, as its text is); other columns are not read; an empty table gives no rows.
    """
    path, kind = path or default_path(), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk
    short = rows.filter(~long).mapInArrow(_whole(path), f"doc_id {kind}, ids array<int>")
    # the number of a row is that of its partition and place in it, so a task that runs again gives the same
    chunks = rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text").filter(long).mapInArrow(_cutter(chunk), _CHUNK.format(kind))
    parts = chunks.repartition("at", "place").mapInArrow(_parts(path), _PART.format(kind))
    return short.unionByName(parts.groupBy("at").applyInPandas(_stitched, f"doc_id {kind}, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, raw) for (doc_id, ids): the bytes of the ids end to end. Null or no ids are no bytes; other columns are not read."""
    path = path or default_path()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            raw, sums = ranks(path).decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            size = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = sums[np.concatenate([[0], np.cumsum(size)])]
            whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, whole.cast(pa.binary())], ["doc_id", "ids", "raw"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(join, f"doc_id {kind}, ids array<int>, raw binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of each text, and of the bytes that they are decoded to."""
    both = decode(encode(docs, path), path)
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
