"""Collapse of cumulative conversation snapshots, and rendering.

A logged conversation that another one continues is a snapshot of it. The hash of
every prefix of turns rolls along the conversation: the sum of 128-bit hashes of the
turns and their places, under a secret drawn for each call, so that nobody can craft
turns whose sums meet. A conversation whose whole hash is the hash of a proper
prefix elsewhere, or another one's whole hash, is compared with it turn by turn, by
cryptographic digests, and goes by an anti-join only if all are equal. Prefix sums
run in two levels, in chunks of turns and over chunks, so a long conversation is
many small groups.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK_TURNS = 256
#: Turns without a number come first, in chunks by their digest, as they are ordered by it.
NULL_CHUNK = -(1 << 62)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest); the digest tells role and text apart, so it is equal only for equal turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))


def prefix_hashes(conversations: DataFrame, secret: str | None = None) -> DataFrame:
    """(conv_id, place, total, digest, p1, p2): for every turn its digest and the hash of all turns up to it; total is the number of turns."""
    secret = secret or secrets.token_hex(16)
    null = F.lit(NULL_CHUNK) + F.conv(F.substring("digest", 1, 2), 16, 10).cast("long")
    turns = written(_turns(conversations).select("conv_id", "turn", "digest", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), null).alias("chunk")), "turns")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "digest")
    placed = turns.join(starts, ["conv_id", "chunk"]).withColumn("place", F.col("start") + F.row_number().over(order))
    hashes = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{secret}{i}"), "place", "digest"), 1).cast("decimal(20,0)").alias(f"t{i}") for i in (1, 2))
    placed = written(placed.select("conv_id", "chunk", "place", "total", "digest", *hashes), "places")
    sums = placed.groupBy("conv_id", "chunk").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    sums = sums.select("conv_id", "chunk", *(F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    along = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.join(sums, ["conv_id", "chunk"])
    return rolled.select("conv_id", "place", "total", "digest", *((F.col(f"b{i}") + F.sum(f"t{i}").over(along)).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that no other continues; of equal ones the least conv_id."""
    hashed, same = written(prefix_hashes(conversations), "prefixes"), ["place", "p1", "p2"]
    whole = written(hashed.filter("place = total").select("conv_id", *same), "whole")
    ends = whole.groupBy(*same).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    longer = hashed.filter("place < total").groupBy(*same).agg(F.min("conv_id").alias("longer"))
    ends = written(ends.join(longer, same, "left"), "ends")
    # each conversation has one other at most that it may be part of: its least copy, or one that continues it
    found = whole.join(ends, same).select("conv_id", "place", "copies", F.when(F.col("conv_id") != F.col("least"), F.col("least")).otherwise(F.col("longer")).alias("other"))
    found = written(found, "found")
    turns = hashed.select("conv_id", F.col("place").alias("at"), "digest")
    mine = found.filter("other is not null").select("conv_id", "place", "other").join(turns, "conv_id")
    equal = mine.join(turns.withColumnRenamed("conv_id", "other"), ["other", "at", "digest"])
    part = equal.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("place")).filter("n = place")
    return found.join(part.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def collapse(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, rendered.

    Turns are in the order of turn, null first, and equal turns in one fixed order (equal
    numbers of a conversation are one group, which is not split);
    rows that repeat are turns of their own, of texts of any length. Null role or text is empty. Rows without
    conv_id belong to no conversation and are left out. Equal conversations leave the
    least conv_id. An empty table gives no rows; other columns are not read.
    """
    kept = written(maximal(conversations), "maximal").select("conv_id", "n_turns")
    turns = _turns(conversations).join(kept, "conv_id")
    said = F.sort_array(F.collect_list(F.struct("turn", "digest", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("text"))))
    return turns.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_join(said["text"], "").alias("rendered"))
