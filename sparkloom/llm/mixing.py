"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's
target over its source's size. The prefix sum of these runs over the source's
documents ordered by size class; one offset is added for each source, and a
document is taken once for each integer that the sum crosses. Rows are ranked in
two levels, in chunks of about the square root of a size class and then over the
chunks, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, join_counted, places, written

WEIGHTS = (5, 2, 1)
#: The mix has so many times the words of all documents; no source has more than so many times its own.
TOTAL, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def unit(text: Column) -> Column:
    """A number from 0 up to 2**32 that the text alone decides."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _along(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows, narrow and with unique order, with place, their number from 1 on, and for each name in sums the sum of a column over all rows before.

    Rows are dealt by ranges of the order and numbered within a range; only one row a
    range is numbered in one task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    per = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n0"), *(F.sum(c).alias(f"{name}0") for name, c in sums.items()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", *(f"{name}0" for name in sums))))
    within = Window.partitionBy("range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("place", F.row_number().over(within)).select("*", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(name) for name, c in sums.items()))
    found = found.join(F.broadcast(bases), "range")  # a row a partition
    return found.select(*rows.columns, (F.col("place") + F.col("n0")).alias("place"), *((F.col(name) + F.col(f"{name}0")).alias(name) for name in sums))


def targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, target): weights shared until no source is above MOST times its size.

    The water level is found in closed form over the table of sources, one row a source, however many.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    cycle = F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS)))
    w = _along(per, ["skey"], {}).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (cycle + 1).cast("int")).cast("double")).drop("place")
    w = w.withColumn("cap", F.col("source_size") * MOST)
    w = written(_along(w.withColumn("by", F.col("cap") / F.col("w")), ["by", "skey"], {"caps": "cap", "weights": "w"}), "filled")
    everything, weights = w.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float((everything or 0) * TOTAL)) - F.col("caps")) / (F.lit(weights or 1.0) - F.col("weights"))
    w = w.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    water = w.filter(~F.col("full")).agg(F.min(F.struct("place", "level"))["level"]).first()[0]
    return w.select("skey", "source_size", F.when(F.lit(water is None) | F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(water or 0.0) * F.col("w")).alias("target"))


def mix(docs: DataFrame, placed: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies (0 to 2), and row, a unique number.

    If placed, docs is a scanned table, and file and row name its rows. A null text has
    size 0; a null source is a source of its own. Rows that repeat, null ids included,
    are ranked as rows of their own. A source without words has target 0. Texts of any
    length are read whole. An empty table gives no rows. The result depends on the rows alone.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size, name = word_count(F.col("text")), places(docs) if placed else [F.monotonically_increasing_id().alias("row")]
    names = ["file", "row"] if placed else ["row"]
    sized = docs.select("doc_id", *name, source_key(F.col("source")).alias("skey"), size.alias("size"), unit(key).alias("h"))
    binary = F.bin("size")
    sized = written(sized.withColumn("class", F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 3))), "sizes")
    sources = written(targets(sized), "targets")
    classes = written(sized.groupBy("skey", "class").agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("chunks")), "classes")
    chunk = F.floor(F.col("h") * F.col("chunks") / F.lit(2.0**32))
    named = sized.join(F.broadcast(classes), ["skey", "class"]) if few(classes) else join_counted(sized, classes, ["skey", "class"], "rows")
    chunked = named.withColumn("chunk", chunk)
    counts = chunked.groupBy("skey", "class", "chunk").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("skey").orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("skey", "class", "chunk", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base")), "chunks")
    within = Window.partitionBy("skey", "class", "chunk").orderBy("h", "doc_id", *names)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    bases = bases.join(sources.withColumn("rate", rate), "skey")
    ranked = chunked.withColumn("place", F.row_number().over(within)).join(bases, ["skey", "class", "chunk"])
    offset, rank = unit(F.col("skey")) / F.lit(2.0**32), F.col("base") + F.col("place")
    copies = F.floor(offset + F.col("rate") * rank) - F.floor(offset + F.col("rate") * (rank - 1))
    copies = F.least(copies, F.lit(MOST)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *names)
