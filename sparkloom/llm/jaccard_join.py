"""Exact n-gram Jaccard join by T-occurrence search over inverted lists.

A document is the set of its word shingles, as 64-bit hashes under a key drawn anew
for every call, so that no text can be made to collide. Documents with the
same set are one class. For two sets to link they must share T shingles, so

1. a set that shares fewer than T of its shingles with any other text is out.
   Hashes are grouped by range for this, four bytes each, packed by task; what a
   pack repeats itself is sent once, so a common shingle is sent once a pack;
2. inverted lists are built for the sets left. The T - 1 longest lists of a set
   are never merged; the others are its short lists, and linked sets share one;
3. sets that short lists connect form clusters, and every cluster is searched
   where its sets are: short lists are heap-merged, and a set met often enough is
   probed by bisection in the long lists (DivideSkip). Large clusters are cut into
   tiles of two blocks of sets of like size; a tile is one group.

Links of classes are then joined to components.
"""

from __future__ import annotations

import math
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from .common import by_place, join_counted, places, scanned, written
from .components import components

WORDS, PERCENT = 4, 85
#: Shingles of a pack of documents, and of a range of hashes, at about which each ends.
PACK, RANGE = 2_000_000, 2_000_000
#: Sets and shingles of a block; a cluster of up to two blocks is searched whole.
BLOCK, BLOCK_SHINGLES = 64, 2_000_000


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    a = T.mix(hashes ^ np.uint64(0x51ED270B0B1F2A47)).sum(dtype=np.uint64)
    b = T.mix(hashes + np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*places(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def class_keys(docs: DataFrame, words: int = WORDS, key: int = 0) -> DataFrame:
    """(file, row, doc_id, n, cid) of every row; cid is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s) if len(s) else None) for s in T.shingle_sets(batch.column(3), words, key)]
            n, keys = zip(*sets) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["file", "row", "doc_id", "n", "cid"])

    return _named(docs).mapInArrow(run, "file long, row long, doc_id long, n long, cid binary")


def _packs(docs: DataFrame, words: int, bits: int, key: int) -> DataFrame:
    """(r, pack, hashes, counts, home): for each pack and range of hashes, the hashes that one text of the pack has
    alone, text by text, and those that several have; home, in range 0, names the pack's texts."""

    def flush(pack: int, ids: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(hashes), bool)
        again[1:] |= same
        again[:-1] |= same
        shared = np.bincount(owner[order[again]], minlength=len(sets))
        common, alone = np.unique(ordered[again]), np.ones(len(hashes), bool)
        alone[order[again]] = False
        top = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        low = lambda h: ((h << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        hashes, owner = hashes[alone], owner[alone]
        ranges = top(hashes)
        order = np.argsort(ranges, kind="stable")
        edges, common_edges = np.searchsorted(ranges[order], np.arange((1 << bits) + 1)), np.searchsorted(top(common), np.arange((1 << bits) + 1))
        small_hashes, small_common, owner = low(hashes[order]), low(common), owner[order]
        rows = []
        for r in range(1 << bits):
            a, b, c, d = *edges[r : r + 2], *common_edges[r : r + 2]
            counts = np.bincount(owner[a:b], minlength=len(sets)).astype("<u4")
            home = np.stack([*np.array(ids, np.int64).T, sizes, shared]).tobytes() if r == 0 else None
            rows.append((r, pack, small_hashes[a:b].tobytes() + small_common[c:d].tobytes(), counts.tobytes(), home))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["r", "pack", "hashes", "counts", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, ids, sets, keys, held = TaskContext.get().partitionId() << 32, [], [], set(), 0
        for batch in batches:
            for i, s in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), T.shingle_sets(batch.column(2), words, key)):
                if not len(s) or (name := set_key(s)) in keys:
                    continue
                keys.add(name)
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held >= PACK:
                    yield flush(pack, ids, sets)
                    pack, ids, sets, keys, held = pack + 1, [], [], set(), 0
        if ids:
            yield flush(pack, ids, sets)

    return _named(docs).drop("doc_id").mapInArrow(run, "r long, pack long, hashes binary, counts binary, home binary")


def _shared_in_range(_: tuple, table: pa.Table) -> pa.Table:
    """For every pack the number of each text's hashes of the range that another text has too."""
    rows = table.to_pylist()
    arrays = [np.frombuffer(row["hashes"], "<u4") for row in rows]
    every = np.concatenate(arrays)
    ordered = np.sort(every)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = []
    for row, hashes in zip(rows, arrays):
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        own = hashes[: counts.sum()]
        # alone in its pack, so seen twice means seen elsewhere
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        hit = np.concatenate([[0], np.cumsum(twice[at] == own if len(twice) else np.zeros(len(own), bool))])
        ends = np.cumsum(counts)
        out.append((hit[ends] - hit[ends - counts]).astype("<u4").tobytes())
    return pa.table({"pack": pa.array([x["pack"] for x in rows], pa.int64()), "shared": pa.array(out, pa.binary()), "home": pa.array([x["home"] for x in rows], pa.binary())})


def _left_over(percent: int):
    def run(_: tuple, table: pa.Table) -> pa.Table:
        total, home = 0, None
        for shared, named in zip(table.column("shared").to_pylist(), table.column("home").to_pylist()):
            total = total + np.frombuffer(shared, "<u4").astype(np.int64)
            home = home or named
        file, row, sizes, inside = np.frombuffer(home, np.int64).reshape(4, -1)
        enough = 100 * (total + inside) >= percent * sizes
        return pa.table({"file": pa.array(file[enough]), "row": pa.array(row[enough])})

    return run


def candidates(docs: DataFrame, total: int, words: int, percent: int, key: int) -> DataFrame:
    """(file, row) of a row of each set, or of a few, that shares enough shingles with other sets of the table."""
    bits = max(0, math.ceil(math.log2(max(total, 1) / RANGE)))
    ranges = _packs(docs, words, bits, key).groupBy("r").applyInArrow(_shared_in_range, "pack long, shared binary, home binary")
    return ranges.groupBy("pack").applyInArrow(_left_over(percent), "file long, row long")


def shingle_table(docs: DataFrame, words: int, key: int) -> DataFrame:
    """(cid, n, sh): the classes of docs with their sorted shingles, once a task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {set_key(s): s for s in T.shingle_sets(batch.column(0), words, key) if len(s)}
            sets = [s.view(np.int64) for s in seen.values()]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(np.diff(off).astype(np.int64)), lists], ["cid", "n", "sh"])

    return docs.selectExpr("cast(text as string) text").mapInArrow(run, "cid binary, n long, sh array<long>")


def required(n: int, m: int, percent: int) -> int:
    """Shared shingles that link sets of n and m: 100 * shared >= percent * (n + m - shared)."""
    return -(-percent * (n + m) // (100 + percent))


def _search(percent: int):
    """Links of a group of sets, as edges from each set to the first of its local component."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("cid", "ascending")])
        names, sizes = table.column("cid").to_pylist(), table.column("n").to_pylist()
        column = table.column("sh").combine_chunks()
        values, off = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        _, number = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(len(names)), sizes)
        order = np.argsort(number, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(number))])
        lists = owner[order]
        length = np.diff(edges)
        inverted: dict[int, list[int]] = {}
        for token in np.flatnonzero(length > 1).tolist():
            inverted[token] = lists[edges[token] : edges[token + 1]].tolist()
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, n in enumerate(sizes):  # partners are the larger sets, that come later
            mine = [inverted[t] for t in number[off[x] : off[x + 1]].tolist() if t in inverted]
            least = required(n, n, percent)
            if len(mine) < least:
                continue
            mine.sort(key=len)
            cut = len(mine) - (least - 1)
            short, long = mine[:cut], mine[cut:][::-1]
            last, count = -1, 0
            for y in merge(*(z[bisect_left(z, x + 1) :] for z in short), [len(names)]):
                if y == last:
                    count += 1
                    continue
                if last >= 0 and root(last) != root(x):
                    need, left = required(n, sizes[last], percent), len(long)
                    for probed in long:
                        if count >= need or count + left < need:
                            break
                        at = bisect_left(probed, last)
                        count += at < len(probed) and probed[at] == last
                        left -= 1
                    if count >= need:
                        parent[max(root(x), root(last))] = min(root(x), root(last))
                last, count = y, 1
        found = [(names[i], names[root(i)]) for i in range(len(names)) if root(i) != i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


def _tiles(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Sets with the tile that they are searched in; a set of a large cluster is in several."""
    member = written(sets.select("cid", "n").join(clusters.select(F.col("node").alias("cid"), "root"), "cid"), "members")
    member = member.withColumn("g", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)))
    large = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"))
    most = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))
    blocks = member.groupBy("root", "g").agg(F.ceil(most).alias("blocks"), F.count(F.lit(1)).alias("sets"))
    up = blocks.select("root", (F.col("g") - 1).alias("g"), F.col("blocks").alias("above"))
    down = blocks.select("root", (F.col("g") + 1).alias("g"), F.col("blocks").alias("below"))
    whole = (F.col("size") <= 2 * BLOCK) & (F.col("all") <= 2 * BLOCK_SHINGLES)
    plan = written(blocks.join(large, "root").join(up, ["root", "g"], "left").join(down, ["root", "g"], "left").withColumn("whole", whole), "blocks")
    at = join_counted(member, plan, ["root", "g"], "sets").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    name = lambda g, i, h, j: F.concat_ws(":", g, i, h, j)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    g, block = F.col("g"), F.col("block")
    same = F.transform(upto(F.col("blocks")), lambda j: name(g, F.least(block, j), g, F.greatest(block, j)))
    over = F.transform(upto(F.coalesce(F.col("above"), F.lit(0))), lambda j: name(g, block, g + 1, j))
    under = F.transform(upto(F.coalesce(F.col("below"), F.lit(0))), lambda j: name(g - 1, j, g, block))
    tile = F.when(F.col("whole"), F.array(F.lit(""))).otherwise(F.concat(same, over, under))
    return at.select("cid", "root", F.explode(tile).alias("tile"))


def class_links(docs: DataFrame, total: int, words: int, percent: int, key: int) -> DataFrame:
    """(a, b): edges between classes whose components are those of all links."""
    left = written(candidates(docs, total, words, percent, key), "candidates")
    texts = by_place(docs.select("text"), left, "left_semi")
    sets = written(shingle_table(texts, words, key).groupBy("cid").agg(F.first("n").alias("n"), F.first("sh").alias("sh")), "sets")
    posting = sets.select("cid", "n", F.explode("sh").alias("s"))
    lengths = written(posting.groupBy("s").agg(F.count(F.lit(1)).alias("length")).filter("length > 1"), "lengths")
    ranked = join_counted(posting, lengths, ["s"], "length").groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("length", "s"))).alias("lists"))
    short = F.size("lists") - (F.ceil(F.col("n") * percent / 100) - 1)
    short = ranked.select("cid", F.explode(F.slice("lists", F.lit(1), F.greatest(short, F.lit(0)).cast("int"))["s"]).alias("s"))
    short = written(short, "short")
    first = written(short.groupBy("s").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("length")).filter("length > 1"), "firsts")
    near = join_counted(short, first, ["s"], "length").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    clusters = written(components(near), "clusters")
    tiles = _tiles(sets, clusters, percent).join(sets, "cid")
    return tiles.groupBy("root", "tile").applyInArrow(_search(percent), "a binary, b binary")


def _rooted(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """class_keys of docs, a scanned table, and (cid, root, least, n_rows) of its classes: the component, the least doc_id of the class, its rows."""
    key = secrets.randbits(64)
    keys = written(class_keys(docs, words, key), "classes")
    total = keys.agg(F.sum("n")).first()[0] or 0
    links = written(class_links(docs, total, words, percent, key), "links")
    roots = written(components(links), "components")
    classes = keys.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    classes = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return keys, written(classes, "leasts")


def copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(file, row) of the rows of docs, a scanned table, that are not the first of their component.

    The first has the least doc_id, null last; of rows with that id one stays. Rows
    without words have no component and are never named.
    """
    keys, classes = _rooted(docs, words, percent)
    rows = join_counted(keys.filter("cid is not null"), classes, ["cid"], "n_rows").select("root", "doc_id", "file", "row")
    rows = written(rows, "rooted")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    first = written(rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    return join_counted(rows, first, ["root"], "n").filter(place != F.col("first")).select("file", "row")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Texts are lower-cased in A-Z and split at white space; with fewer words than a
    shingle the whole sequence is the one shingle. A null or empty text has none, is
    linked with nothing and has its own doc_id as component. component_id is the
    smallest doc_id that links reach; null ids are passed over, so it is null only
    where all are. Rows that repeat are equal texts and linked. Texts of any length are
    read whole; doc_id is an integer. An empty table gives no rows; other columns of
    docs are not read.
    """
    keys, classes = _rooted(scanned(docs), words, percent)
    least = written(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "minima")
    named = written(join_counted(classes, least, ["root"], "n").select("cid", "component_id", "n_rows"), "names")
    linked = join_counted(keys.filter("cid is not null"), named, ["cid"], "n_rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(keys.filter("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
