"""Token ids packed into rows of a fixed width, best fit first, longest piece first.

Each task encodes its documents as they come and packs a shard whenever it holds
SHARD_TOKENS; nothing is shuffled and memory is bounded by a shard and one
document. A document longer than a row is cut into full rows and a rest, so no id
is lost. The rests, longest first, each go to the row with the least room that
still holds them; a segment tree over capacities finds it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as T
from . import tokenizer as K

WIDTH = 2048
SHARD_TOKENS = 2_000_000
#: Ends every document and fills rows: the first id that is free in the default vocabulary. Others have one of their own, see Encoder.
END = 50_256
#: Ids kept before the table of pieces is dropped and built again.
MOST_IDS = 4_000_000


class Encoder:
    """Ids of texts; each distinct piece is encoded once while the table of pieces has room."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: The id that ends documents, and the type that holds all ids.
        self.end = max(ranks.values()) + 1
        self.type = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids, self.used = K.PieceCache(), np.zeros(1 << 20, self.type), 0

    def _learn(self, found: K.Pieces, new: np.ndarray) -> np.ndarray:
        """Where the ids of the pieces new begin, and how many they are, as one number a piece."""
        each = [self.library._encode_single_piece(found.data[a : a + n].tobytes()) for a, n in zip(found.starts[new].tolist(), found.size[new].tolist())]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), self.type, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        value = at << 30 | sizes
        self.known.add(found, new, value)
        return value

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the first id of each text."""
        starts, ends, first = K.pieces(data, off)
        found = K.Pieces(data, starts, ends)
        if self.used > MOST_IDS or len(self.known.keys) + len(found.keys) > K.PieceCache.MOST:
            self._clear()
        value, hit = self.known.find(found)
        new = np.flatnonzero(~hit)
        if len(new):
            value[new] = self._learn(found, new)
        value = value[found.back]
        at, size = value >> 30, value & (1 << 30) - 1
        sums = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(sums[-1]) + np.repeat(at - sums[:-1], size)
        return self.ids[index], sums[first]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Room:
    """Rows by the room they have left; a segment tree over capacities finds the least that is enough."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.any = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.any[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least need, taken out, and its room."""
        node = need + self.size
        if not self.any[node]:
            while node & 1 or not self.any[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node *= 2
                node += not self.any[node]
        room = node - self.size
        self._count(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """For each row the pieces, by index, that it holds, in order."""
    room, rows = Room(width), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[piece])
        row, left = found or (len(rows), width)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if left > sizes[piece]:
            room.put(row, left - sizes[piece])
    return rows


SCHEMA = "shard long, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


def pack_shard(shard: int, doc_ids: list, texts: list[np.ndarray], width: int, end_id: int = END, type_: np.dtype | str = "<u2") -> pa.RecordBatch:
    pieces = [(d, o, min(width, len(t) - o)) for d, t in enumerate(texts) for o in range(0, len(t), width)]
    out: dict[str, list] = {k: [] for k in ("shard", "row", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets")}
    for row, held in enumerate(best_fit_decreasing([n for _, _, n in pieces], width)):
        held = [pieces[i] for i in held]
        ids = np.full(width, end_id, type_)
        ends = np.cumsum([n for _, _, n in held]).tolist()
        for (d, o, n), end in zip(held, ends):
            ids[end - n : end] = texts[d][o : o + n]
        values = (shard, row, ids.tobytes(), ends[-1], [0, *ends], [0, *ends[:-1]], [doc_ids[d] for d, _, _ in held], [o for _, o, _ in held])
        for k, v in zip(out, values):
            out[k].append(v)
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each row of the packed id matrices.

    ids has width little-endian ids, of 16 bits or, if the vocabulary has more, 32, filled
    up after n_tokens with the id behind the vocabulary, which also ends documents;
    segment i is ids[cu_seqlens[i]:cu_seqlens[i + 1]], the document doc_ids[i] from
    its id number doc_offsets[i] on; positions count from 0 again at every entry of
    position_resets. Every document ends with one, so an empty or null text is one
    id. A null doc_id stays null in doc_ids, which are integers; rows that repeat are
    packed each, texts of any length whole. Shards are cut task by task, so another
    split of the files packs the same documents into other rows. Other columns of docs
    are not read; an empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        own = encoder(path)
        end = np.array([own.end], own.type)
        for batch in batches:
            data, off = T.flat(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in T.slices(off):
                tokens, first = own.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for i, x, y in zip(range(a, b), first[:-1].tolist(), first[1:].tolist()):
                    ids.append(names[i])
                    texts.append(np.concatenate([tokens[x:y], end]))
                    held += y - x + 1
                    if held >= shard_tokens:
                        yield pack_shard(shard, ids, texts, width, own.end, own.type)
                        shard, ids, texts, held = shard + 1, [], [], 0
        if ids:
            yield pack_shard(shard, ids, texts, width, own.end, own.type)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


MATRIX = "shard long, n_rows int, width int, matrix binary, row_starts array<int>, cu_seqlens array<int>, position_resets array<int>"


def matrices(packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each shard of pack(): matrix is n_rows * width ids, row after row; the others are those of all rows, counted from its first id.

    row_starts says where in cu_seqlens the segments of each row begin. A shard is at most
    SHARD_TOKENS ids and one document, so a matrix is a value of a few megabytes. An
    empty table gives no rows.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("row").to_pylist()
        starts = np.cumsum([0, *(len(r["position_resets"]) for r in rows)])
        ends = [i * width + e for i, r in enumerate(rows) for e in r["cu_seqlens"][1:]]
        resets = [i * width + e for i, r in enumerate(rows) for e in r["position_resets"]]
        values = ([key[0].as_py()], [len(rows)], [width], [b"".join(r["ids"] for r in rows)], [starts.tolist()], [[0, *ends]], [resets])
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3)
        return pa.table([pa.array(v, t) for v, t in zip(values, types)], [part.split()[0] for part in MATRIX.split(", ")])

    return packed.select("shard", "row", "ids", "cu_seqlens", "position_resets").groupBy("shard").applyInArrow(run, MATRIX)
