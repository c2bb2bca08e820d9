"""The search pass as one flow: drain what is cached, take what is due, attribute results, advance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cadence


@dataclass(frozen=True)
class Pass:
    """What a pass leaves, all of it or none: see streaming.ledger."""

    drained: DataFrame
    phrases: DataFrame
    cursor: DataFrame


def page_key(phrase: Column, page: Column) -> Column:
    """The key of a phrase's page in the cache of answers."""
    return F.concat(phrase, F.lit("#"), page.cast("string"))


def search_pass(grid: DataFrame, cursor: int, size: int, block: int, is_due: Column, cache: DataFrame, as_of: Column, ttl: float, results: DataFrame, page_cap: int) -> Pass:
    """grid (position, phrase, page, dry), cache (key, at, harvested), results (note).

    drained: what is cached, fresh and not harvested. phrases (phrase, page, found, next_page, next_dry): the next block due phrases from the
    cursor on, around the end; found counts the results that a note names by the phrase or by its page's key. A page that brought
    something leads to the next, the second empty one in a row, or the cap, back to the first. cursor (cursor): behind the block. Without
    any result nothing advances.
    """
    walked = cadence.due_walk(grid, "position", size, cursor, is_due, block)
    batch = walked.select("position", "turn", "phrase", "page", "dry")
    names = batch.select("phrase", F.explode(F.array("phrase", page_key(F.col("phrase"), F.col("page")))).alias("name"))
    named = results.select(cadence.after_first(F.col("note")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = names.join(named, "name").groupBy("phrase").agg(F.sum("n").alias("found"))
    covered = results.limit(1).agg((F.count(F.lit(1)) > 0).alias("covered")).scalar()
    both = batch.join(found, "phrase", "left").select("*", covered.alias("covered")).withColumn("found", F.coalesce("found", F.lit(0)))
    new, over = F.col("found") > 0, (F.col("dry") + 1 >= 2) | (F.col("page") >= page_cap)
    page = F.when(~F.col("covered"), F.col("page")).when(new & (F.col("page") < page_cap), F.col("page") + 1).when(new | over, 1).otherwise(F.col("page") + 1)
    dry = F.when(~F.col("covered"), F.col("dry")).when(new | over, 0).otherwise(F.col("dry") + 1)
    moved = cadence.walk_end(walked, size, cursor, block).select(F.when(covered, F.col("cursor")).otherwise(cursor).cast("long").alias("cursor"))
    phrases = both.select("phrase", "page", "found", page.alias("next_page"), dry.alias("next_dry"))
    return Pass(cadence.drain(cache, "at", "harvested", as_of, ttl, "key"), phrases, moved)
