"""Duplicates, page roll-ups and keepers."""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

# Fixed values.
DISCOUNT_RANK = {"free": 3, "percent": 2, "fixed": 1}


#: Tokens of the classes that one task meets at a time, about; a pair of such blocks is a group.
BLOCK_TOKENS = 1 << 21
#: So many of the commonest tokens are told apart by how common they are; the rest counts as rare.
COMMON_TOKENS = 1 << 17
#: Groups that hosts of less than a block are dealt into.
SMALL_HOSTS = 4096


def _near_pairs(ids: np.ndarray, size: np.ndarray, tokens: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs (larger, smaller) of ids, one of each side, or both of side 0 if there is no other, whose sets have at least threshold in common.

    tokens has the sets one behind the other, each ascending, rare numbers first. Of like classes the smaller one's first
    tokens hold one of the larger one's (prefix filter); what shares one is counted exactly.
    """
    if not len(tokens):
        return
    n, (_, code) = size, np.unique(tokens, return_inverse=True)
    code = code.astype(np.int32)
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = (np.arange(len(code)) - start[of]).astype(np.int32)
    prefix = lambda share: np.maximum(size - np.ceil(n * share - 1e-9).astype(np.int64) + 1, 0).clip(max=size)
    large, small = prefix(threshold), prefix(2 * threshold / (1 + threshold))
    inside, mark = not side.any(), np.zeros(code.max() + 1, bool)
    for other in (0,) if inside else (0, 1):
        rows = np.flatnonzero((place < small[of]) & (side[of] == other))
        rows = rows[np.argsort(code[rows], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(code[rows], minlength=len(mark)))])
        for i in np.flatnonzero((side == 0) if inside else (side != other)).tolist():
            own = code[start[i] : start[i] + large[i]]
            count = ends[own + 1] - ends[own]
            total = int(count.sum())
            if not total:
                continue
            at = np.repeat(np.arange(len(own)), count)
            hit = rows[np.arange(total) + np.repeat(ends[own] - (np.cumsum(count) - count), count)]
            j = of[hit]
            ok = ((n[j] < n[i]) | ((n[j] == n[i]) & (ids[j] > ids[i]))) & (n[j] >= n[i] * threshold)
            # the first token in common is at these places: no more can follow than is left of either
            ok &= np.minimum(size[i] - at, size[j] - place[hit]) >= np.ceil((n[i] + n[j]) * (threshold / (1 + threshold)) - 1e-9)
            j = np.unique(j[ok])
            if not len(j):
                continue
            mark[code[start[i] : start[i + 1]]] = True
            for k in j.tolist():
                both = int(np.count_nonzero(mark[code[start[k] : start[k + 1]]]))
                if both >= threshold * (n[i] + n[k] - both):
                    yield int(ids[i]), int(ids[k])
            mark[code[start[i] : start[i + 1]]] = False


def _numbered(rows: DataFrame, tokens: str, common: np.ndarray) -> DataFrame:
    """rows with their hashed tokens as numbers in one order, the common ones last, the commonest as the greatest."""
    known = np.sort(common)
    number = len(common) - np.argsort(common, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens)
            value, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            out = value | np.int64(-(2**63))
            if len(known):
                at = np.searchsorted(known, value).clip(max=len(known) - 1)
                out = np.where(known[at] == value, number[at], out)
            out = out[np.lexsort((out, np.repeat(np.arange(len(size)), size)))]
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([made if c == tokens else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _met(classes: DataFrame, host: str, threshold: float) -> DataFrame:
    """(class, ends): the groups (g, p, q) that a class (host, class, n) is searched in, and its side in each; p and q are blocks of a host, or of several small ones.

    A block is a range of sizes of a host, or a part of one that is large; only blocks that can hold like classes are paired.
    """
    sizes = classes.groupBy(host, "n").agg((F.count(F.lit(1)) * F.col("n")).alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy(host).orderBy("n")) - F.col("tokens")  # as many rows as there are sizes
    small = F.sum("tokens").over(Window.partitionBy(host)) <= BLOCK_TOKENS
    group = F.when(small, F.pmod(F.xxhash64(host), F.lit(SMALL_HOSTS))).otherwise(F.xxhash64(host))
    sizes = sizes.select(host, "n", F.floor(before / BLOCK_TOKENS).alias("first"), F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("parts"), group.alias("g"))
    blocked = written(classes.join(sizes, [host, "n"]).select(host, "class", "n", "g", (F.col("first") + F.pmod(F.xxhash64("class"), "parts")).alias("block")), "promos")
    blocks = blocked.groupBy(host, "g", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, q = (blocks.select(host, "g", F.col("block").alias(b), F.col("lo").alias(f"lo_{b}"), F.col("hi").alias(f"hi_{b}")) for b in "pq")
    pairs = p.join(q, [host, "g"]).filter((F.col("p") <= F.col("q")) & (F.col("hi_p") >= F.col("lo_q") * threshold) & (F.col("hi_q") >= F.col("lo_p") * threshold))
    end = lambda b, side: F.struct(F.col(b).alias("block"), F.lit(side).alias("side"))
    both = F.when(F.col("p") == F.col("q"), F.array(end("p", 0))).otherwise(F.array(end("p", 0), end("q", 1)))
    ends = pairs.select(host, "g", "p", "q", F.explode(both).alias("e")).groupBy(host, "e.block").agg(F.collect_list(F.struct("g", "p", "q", "e.side")).alias("ends"))
    return blocked.join(ends, [host, "block"]).select("class", "ends")


def alike(items: DataFrame, host: str, key: str, tokens: str, magnitudes: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, class) and (class, l): items of a host with equal tokens and magnitudes are one class, named by its least key; l is a like class with all magnitudes of class.

    Tokens are 64-bit hashes under a key of this call. Classes are cut into blocks by size, and every two blocks that can hold
    like classes are searched by one task (_near_pairs), so neither candidates nor the token sets of pairs are shuffled.
    """
    given = items.select(F.col(host).alias("host"), F.col(key).alias("id"), F.sort_array(tokens).alias("t"), F.sort_array(magnitudes).alias("m"))
    given = given.filter((F.size("m") > 0) & (F.size("t") > 0) & F.col("host").isNotNull())
    same = F.unhex(F.sha2(F.concat_ws("\u0001", "host", F.concat_ws("\u0002", "t"), F.concat_ws("\u0002", F.transform("m", lambda x: x.cast("string")))), 256))
    secret = F.lit(secrets.randbits(63))
    given = given.select("host", "id", "m", same.alias("same"), F.transform("t", lambda w: F.xxhash64(secret, w)).alias("x"))
    often = given.select(F.explode("x").alias("token")).groupBy("token").count().filter("count > 1").orderBy(F.desc("count"), "token").limit(COMMON_TOKENS)
    common = np.array([r[0] for r in often.select("token").collect()], np.int64)
    base = written(_numbered(given, "x", common), "promos")
    least = base.groupBy("same").agg(F.min("id").alias("class"))
    named = written(base.select("id", "same").join(least, "same").select("id", "class"), "promos")
    # a class has the least id of its items
    classes = base.select("host", F.col("id").alias("class"), F.size("x").alias("n")).join(named.filter("id = class").select("class"), "class", "left_semi")
    met = written(_met(classes, "host", threshold), "promos")
    rows = base.select("host", F.col("id").alias("class"), "x").join(met, "class").select(F.xxhash64(secret, "host").alias("own"), F.col("class").cast("long").alias("class"), "x", F.explode("ends").alias("e")).select("e.g", "e.p", "e.q", "e.side", "own", "class", "x")

    def search(rows: pa.Table) -> pa.Table:
        sets = rows["x"].combine_chunks()
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # a group may have several hosts, whose tokens are not the same
        token = sets.flatten().to_numpy(zero_copy_only=False) ^ np.repeat(rows["own"].to_numpy(), size)
        found = list(_near_pairs(rows["class"].to_numpy(), size, token, rows["side"].to_numpy(), threshold))
        c1, c2 = zip(*found) if found else ((), ())
        return pa.table({"c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64())})

    near = written(rows.groupBy("g", "p", "q").applyInArrow(search, "c1 long, c2 long"), "promos")
    m = lambda i: base.select(F.col("id").alias(f"c{i}"), F.col("m").alias(f"m{i}"))
    has = lambda a, b: F.size(F.array_except(b, a)) == 0
    ways = F.array(F.when(has("m1", "m2"), F.struct(F.col("c2").alias("class"), F.col("c1").alias("l"))), F.when(has("m2", "m1"), F.struct(F.col("c1").alias("class"), F.col("c2").alias("l"))))
    like = near.join(m(1), "c1").join(m(2), "c2")
    return named, like.select(F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("w.class", "w.l")


def promo_duplicates(items: DataFrame, host: str, key: str, tokens: str, magnitudes: str, threshold: float = 0.6) -> DataFrame:
    """(dup_id, keep_id): each item with the first earlier item of its host that has all its magnitudes and a like text.

    Classes of equal items, not items, are paired, so m equal items of a host cost m rows.
    """
    named, links = alike(items, host, key, tokens, magnitudes, threshold)
    others = links.groupBy("class").agg(F.min("l").alias("l"))
    first = F.least("class", "l")
    return named.join(others, "class", "left").filter(first < F.col("id")).select(F.col("id").alias("dup_id"), first.alias("keep_id"))


def leader_clusters(items: DataFrame, host: str, key: str, tokens: str, magnitudes: str, decided: str, threshold: float = 0.6) -> DataFrame:
    """(dup_id, keep_id): undecided items that repeat an earlier leader of their host, with the first such; an item that does not is a leader.

    Decided items lead always. What an undecided one is depends on the earlier ones that it is like, so it is settled in
    rounds: one that is like an earlier leader repeats it, and one whose earlier like items all repeat others leads. Every
    round settles all that it can, over all hosts at once, and the first unsettled item of a host at least; a round is a
    join over classes of equal items, in which only the first undecided item is ever open.
    """
    named, links = alike(items, host, key, tokens, magnitudes, threshold)
    settled = F.coalesce(F.col(decided), F.lit(False)).alias("settled")
    named, links = written(named.join(items.select(F.col(key).alias("id"), settled), "id"), "leaders"), written(links, "leaders")
    firsts = named.groupBy("class").agg(F.min(F.when(F.col("settled"), F.col("id"))).alias("d"), F.min(F.when(~F.col("settled"), F.col("id"))).alias("u"))
    state = written(firsts.withColumn("leads", F.when(F.col("u").isNull(), False)), "leaders")
    leader = F.least("d", F.when(F.col("leads"), F.col("u")))  # the first known leader of a class

    def around(state: DataFrame) -> DataFrame:
        """For each class the first leader that it is like, its own included, and the first open item of the others."""
        theirs = state.select(F.col("class").alias("l"), leader.alias("first"), F.when(F.col("leads").isNull(), F.col("u")).alias("open"))
        near = links.join(theirs, "l").groupBy("class").agg(F.min("first").alias("first"), F.min("open").alias("open"))
        return state.join(near, "class", "left").withColumn("first", F.least("first", leader))

    while not state.filter("leads is null").isEmpty():
        repeats, waits = F.coalesce(F.col("first") < F.col("u"), F.lit(False)), F.coalesce(F.col("open") < F.col("u"), F.lit(False))
        now = F.when(F.col("leads").isNull(), F.when(repeats, False).when(~waits, True)).otherwise(F.col("leads"))
        state = written(around(state).select("class", "d", "u", now.alias("leads")), "leaders")
    cover = around(state).select("class", F.col("first").alias("keep_id"))
    return named.filter("not settled").join(cover, "class").filter("keep_id < id").select(F.col("id").alias("dup_id"), "keep_id")


def best_discount(group: list[str], discounts: DataFrame, kind: str, value: str, position: str) -> DataFrame:
    """Headline of each group: the best kind, then the highest value, then the first."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in DISCOUNT_RANK.items() for x in p))[F.col(kind)], F.lit(0))
    best = F.max_by(F.struct(kind, value), F.struct(rank, F.coalesce(F.col(value), F.lit(0)), -F.col(position)))
    return discounts.filter(F.col(kind).isNotNull()).groupBy(*group).agg(best.alias("best")).select(*group, f"best.{kind}", f"best.{value}")


def first_distinct(position: Column, value: Column) -> Column:
    """Aggregate: distinct values in the order of first position."""
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v"))))
    return F.array_distinct(F.transform(ordered, lambda x: x["v"]))


def keepers(items: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """(group, keeper, size): of each group the row highest by the order, of equals the least key."""
    return items.groupBy(group).agg(F.max_by(key, F.struct(*order, -F.col(key))).alias("keeper"), F.count(F.lit(1)).alias("size"))


def reject_repeated(items: DataFrame, canonical: str, status: str, pending: str = "pending", published: str = "published", rejected: str = "rejected") -> DataFrame:
    """Pending items whose canonical URL is published become rejected."""
    known = items.filter((F.col(status) == published) & F.col(canonical).isNotNull()).select(canonical).distinct().withColumn("_known", F.lit(True))
    joined = items.join(known, canonical, "left")
    return joined.withColumn(status, F.when((F.col(status) == pending) & F.col("_known"), rejected).otherwise(F.col(status))).drop("_known")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
