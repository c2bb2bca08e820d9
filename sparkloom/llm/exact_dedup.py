"""Exact duplicates by two passes over a Bloom filter held as a table of bitmaps.

Pass 1 counts, for two hashed positions of every row, how many rows hit the
position (8 bytes a position are shuffled, combined before) and keeps those hit
more than once. Pass 2 asks for every row: only rows all of whose positions were
hit again are shuffled by their digest and resolved exactly. All other rows are
proven unique and go straight to the result. Texts are never shuffled.

The filter grows with the table, and FILTER_BITMAPS bitmaps of 4 KB are broadcast at
most. Where it is larger, rows are written by ranges of their hash, equal texts in
one, and each range has both passes with a filter of its own; no more rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, join_counted, written

#: Filter positions for each row; the filter grows with the table.
BITS_PER_ROW = 16
SEEDS = (1, 2)
#: Of the hash by whose ranges rows are split.
RANGE_SEED = 3
#: Bitmaps of 32,768 positions, 4 KB each, that may be broadcast together: 64 MB, enough for 33 million rows.
FILTER_BITMAPS = 16_384

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that by itself where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(lower_ascii(text), 256)).alias("digest"))


def repeated(rows: DataFrame, bits: int, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(at, n): the positions that more than one row hits, and how often."""
    return rows.select(F.explode(_positions(bits, seeds)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bitmaps(hits: DataFrame) -> DataFrame:
    """(bucket, bitmap) of these positions."""
    return hits.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _positions(bits: int, seeds: tuple[int, ...] = SEEDS) -> Column:
    return F.array(*(F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(bits)) + 1 for seed in seeds))


def _bit(bitmap: Column, at: Column) -> Column:
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def exact_dedup(docs: DataFrame, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and row, a unique number.

    Texts are equal when equal after lower-casing A-Z; null is the empty text. Of
    equal texts the row with the largest doc_id stays (a null doc_id is smallest;
    of rows with the same doc_id one stays). Texts of any length are read whole. An
    empty table gives no rows; other columns of docs are not read.
    """
    total = docs.count() * bits_per_row
    ranges = _ranges(total)
    bits = max(1 << 15, -(-total // ranges))
    rows = digests(docs).withColumn("range", F.pmod(F.xxhash64("digest", F.lit(RANGE_SEED)), F.lit(ranges)).cast("int"))
    rows = written(rows, "digests", by="range") if ranges > 1 else written(rows.drop("range"), "digests")
    asked = appended((_asked_of(rows.filter(F.col("range") == i).drop("range") if ranges > 1 else rows, bits) for i in range(ranges)), "asked")
    unique = asked.filter(~F.col("maybe")).select("doc_id", "row", "digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    shared = asked.filter("maybe").select("doc_id", "row", "digest")
    groups = written(shared.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    resolved = join_counted(shared, groups, ["digest"], "group_size").select("doc_id", "row", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    return unique.unionByName(resolved).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def _asked(rows: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """rows with maybe: whether both positions are set in the bitmaps, which are broadcast."""
    asked, maybe = rows.withColumn("p", _positions(bits)), F.lit(True)
    for i in (0, 1):
        one = F.broadcast(table.select(F.col("bucket").alias(f"b{i}"), F.col("bitmap").alias(f"m{i}")))
        asked = asked.join(one, F.bitmap_bucket_number(F.col("p")[i]) == F.col(f"b{i}"), "left")
        maybe = maybe & F.col(f"m{i}").isNotNull() & F.coalesce(_bit(F.col(f"m{i}"), F.col("p")[i]), F.lit(False))
    return asked.select("doc_id", "row", "digest", maybe.alias("maybe"))


def _asked_of(rows: DataFrame, bits: int) -> DataFrame:
    """Both passes over the rows of one range, with a filter of so many positions."""
    return _asked(rows, written(bitmaps(repeated(rows, bits)), "bloom"), bits)


def _ranges(bits: int) -> int:
    """Ranges, so that the filter of one may be broadcast. Its size is that of an even share: hashes spread different texts evenly, and
    equal ones, however many, are at the same few positions."""
    return max(1, -(-bits // (max(1, FILTER_BITMAPS) << 15)))
