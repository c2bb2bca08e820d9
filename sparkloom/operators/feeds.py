"""Ordered lists: grids, rotation, interleaving, budgets, top lists, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered, running

#: Words of an axis that may be broadcast.
AXIS_WORDS = 100_000


def grid(*axes: DataFrame) -> DataFrame:
    """Every phrase of one word from each axis (pos, word), the last axis fastest, repeats ignoring case left out; (pos, phrase).

    An axis is a vocabulary of at most AXIS_WORDS words, the first one of any number.
    """
    for axis in axes[1:]:
        if axis.limit(AXIS_WORDS + 1).count() > AXIS_WORDS:
            raise ValueError(f"an axis of a grid has more than {AXIS_WORDS} words")
    named = [a.select(F.col("pos").alias(f"p{i}"), F.col("word").alias(f"w{i}")) for i, a in enumerate(axes)]
    all_ = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), named)  # axes are vocabularies
    place, phrase = F.struct(*(f"p{i}" for i in range(len(axes)))), F.concat_ws(" ", *(f"w{i}" for i in range(len(axes))))
    first = all_.groupBy(F.lower(phrase).alias("key")).agg(F.min(F.struct(place.alias("place"), phrase.alias("phrase"))).alias("x"))
    return numbered(first.select("x.place", "x.phrase"), ["place"]).select("pos", "phrase")


def rotation(rows: DataFrame, position: str, size: int, cursor: int, n: int) -> DataFrame:
    """The n rows of a list of this size from the cursor on, around the end; with their turn."""
    turn = F.pmod(F.col(position) - cursor, F.lit(size))
    return rows.withColumn("turn", turn).filter(F.col("turn") < n)


def interleave(feeds: DataFrame, feed: str, order: list[Column]) -> DataFrame:
    """Rows with their round: the k-th of every feed before the next of any. The order is unique in a feed; a feed of very many rows is numbered by ranges."""
    return running(feeds, [feed], order, {"round": ("count", F.lit(1))})


def top(rows: DataFrame, eligible: Column, order: list[Column], n: int, known: DataFrame | None = None, key: str | None = None) -> DataFrame:
    rows = rows.filter(eligible)
    if known is not None:
        rows = rows.join(known.select(key), key, "left_anti")
    return rows.orderBy(*order).limit(n)


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], eligible: Column, budget: int) -> DataFrame:
    """Per group the leading rows up to the one that uses up the budget of eligible rows."""
    used = running(rows, group, order, {"_used": ("sum", eligible.cast("int"))}, inclusive=False)
    return used.filter(F.coalesce("_used", F.lit(0)) < budget).drop("_used")


def mode_by(rows: DataFrame, group: str, value: str, position: str, least: int = 1) -> DataFrame:
    """(group, value, n): each group's most frequent value, of equals the one seen first."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first")).filter(F.col("n") >= least)
    return counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("x")).select(group, f"x.{value}", "x.n")


def retain_bytes(rows: DataFrame, group: list[str], newest_first: list[Column], size: Column, most: int) -> DataFrame:
    """Per group the newest rows whose sizes add up to at most `most`, and the newest in any case."""
    kept = running(rows, group, newest_first, {"_sum": ("sum", size), "_rn": ("count", F.lit(1))})
    return kept.filter((F.col("_sum") <= most) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def newest(rows: DataFrame, group: list[str], newest_first: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; a group of very many rows is numbered by ranges."""
    return running(rows, group, newest_first, {"_rn": ("count", F.lit(1))}).filter(F.col("_rn") <= n).drop("_rn")


def unseen(rows: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """Rows whose normalised key is not known."""
    return rows.withColumn("_k", key).join(known.select(known_key.alias("_k")), "_k", "left_anti").drop("_k")
