"""Merkle fixity audit of web archive records.

Every record is hashed as it would stand in the archive file. Records are ordered
by id; a node of the tree covers an id range and with it an offset range of the
file. Its digest is of what lies below, in order: name, offset from the start of the
node, length and digest of each record or node. FANOUT ranges make one of the next
level, up to one root. Two replicas are compared from the root and only below nodes
that differ, down to the records. As offsets count from the start of a node, a lost
record changes the nodes above it and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 64
#: Ids of one archive file; offsets of records count from 0 in each.
VOLUME = 4096


def records(pages: DataFrame) -> DataFrame:
    """(page_id, length, digest) of each record; the header has a date and a record id where pages has columns warc_date and warc_record_id."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    more = [F.concat(F.lit(f"\r\n{field}: "), F.coalesce(F.col(name).cast("string"), F.lit(""))) for field, name in (("WARC-Date", "warc_date"), ("WARC-Record-ID", "warc_record_id")) if name in pages.columns]
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, *more, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def leaves(recorded: DataFrame) -> DataFrame:
    """(page_id, digest, copies, length): equal records of one id are one leaf, length that of all of them."""
    return recorded.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.sum("length").alias("length"))


def _node(level: int):
    return F.floor(F.col("page_id") / F.lit(FANOUT**level)).cast("long")


def _level(below: DataFrame, node: Column, order: list[str], name: Column) -> DataFrame:
    """(node, digest, length) of the nodes over these ranges."""
    within = Window.partitionBy("node").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = below.select(node.alias("node"), *order, "length", name.alias("name"), F.col("digest").alias("of")).withColumn("start", F.coalesce(F.sum("length").over(within), F.lit(0)))
    text = F.struct("start", *order, F.concat_ws(":", "name", "start", "length", "of").alias("text"))
    whole = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(text))["text"]), 256)
    return named.groupBy("node").agg(whole.alias("digest"), F.sum("length").alias("length"))


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (node, digest, length) of levels 1, the id ranges, to the root, of leaves with an id."""
    out = [written(_level(leaf, _node(1), ["page_id", "digest"], F.concat_ws("x", "page_id", "copies")), "tree")]
    for _ in range(1, levels):
        up = out[-1].withColumnRenamed("node", "below")
        out.append(written(_level(up, F.floor(F.col("below") / FANOUT).cast("long"), ["below"], F.col("below").cast("string")), "tree"))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("node", F.col("digest").alias("x")).join(b.select("node", F.col("digest").alias("y")), "node", "full_outer")
    return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node")


def corrupt(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page_id, digest, status) of leaves that differ: changed, missing (theirs lacks it) or extra (only theirs has it)."""
    bounds = [d.agg(F.min("page_id"), F.max("page_id")).first() for d in (ours, theirs)]
    reach = max([1, *(abs(x) + 1 for row in bounds for x in row if x is not None)])
    levels = next(k for k in range(1, 12) if FANOUT**k >= reach) + 1
    a, b = (tree(x.filter("page_id is not null"), levels) for x in (ours, theirs))
    bad = written(_differing(a[-1], b[-1]), "differ")
    for x, y in zip(a[-2::-1], b[-2::-1]):
        below = [t.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(bad.withColumnRenamed("node", "up"), "up", "left_semi").drop("up") for t in (x, y)]
        bad = written(_differing(*below), "differ")
    # records without an id have no place in the order and are compared each
    found = [t.withColumn("node", _node(1)).join(bad, "node", "left_semi").drop("node").unionByName(t.filter("page_id is null")) for t in (ours, theirs)]
    lost, new = (x.join(y, reduce(lambda p, c: p & x[c].eqNullSafe(y[c]), ("digest", "copies"), x["page_id"].eqNullSafe(y["page_id"])), "left_anti") for x, y in (found, found[::-1]))
    lost, new = lost.select("page_id", "digest"), new.select("page_id", "digest")
    ids = new.select(F.col("page_id").alias("other")).distinct()
    marked = lost.join(ids, lost["page_id"].eqNullSafe(ids["other"]), "left").select("page_id", "digest", F.when(F.col("other").isNull() & F.col("page_id").isNotNull(), "missing").otherwise("changed").alias("status"))
    only = new.join(lost.select(F.col("page_id").alias("other")).distinct(), F.col("page_id").eqNullSafe(F.col("other")), "left_anti")
    return marked.unionByName(only.select("page_id", "digest", F.lit("extra").alias("status")))


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of pages, and one for each extra one of the replica: page_id, volume, record_offset,
    record_length, record_sha256, range_id, status.

    status is ok, changed, missing or extra; extra records have no volume, offset or
    length. Null texts are empty, texts of any length are read whole; records without
    an id have no volume, offset or range. Equal rows are copies and must be as many in
    both. An empty table has an empty tree; other columns are not read, but for
    warc_date and warc_record_id.
    """
    ours, theirs = written(records(pages), "records"), written(records(replica), "records")
    bad = written(corrupt(written(leaves(ours), "leaves"), written(leaves(theirs), "leaves")), "corrupt")
    before = Window.partitionBy("volume").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    kept = ours.filter("page_id is not null").withColumn("volume", F.floor(F.col("page_id") / VOLUME).cast("long"))
    kept = kept.withColumn("record_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    none = [F.lit(None).cast("long").alias(c) for c in ("volume", "record_offset")]
    kept = kept.unionByName(ours.filter("page_id is null").select("*", *none))
    own = bad.filter("status <> 'extra'").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "status")
    kept = kept.join(own, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    out = kept.select("page_id", "volume", "record_offset", F.col("length").alias("record_length"), F.col("digest").alias("record_sha256"), _node(1).alias("range_id"), F.coalesce("status", F.lit("ok")).alias("status"))
    extra = bad.filter("status = 'extra'").select("page_id", *none, F.lit(None).cast("long").alias("record_length"), F.col("digest").alias("record_sha256"), _node(1).alias("range_id"), "status")
    return out.unionByName(extra)
