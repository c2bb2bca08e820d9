"""What is due when: cached answers, walks over due entries, waits between requests, cooldowns, cursors, accounts.

Times are seconds as numbers; the present is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def fresh(at: Column, as_of: Column, ttl: float) -> Column:
    """Whether an entry of that time is younger than ttl; a missing entry is not."""
    return F.coalesce(as_of - at < ttl, F.lit(False))


def due_walk(rows: DataFrame, position: str, size: int, cursor: int, is_due: Column, n: int) -> DataFrame:
    """The first n due rows of a list of this size from the cursor on, around the end; with their turn."""
    return rows.filter(is_due).withColumn("turn", F.pmod(F.col(position) - cursor, F.lit(size))).orderBy("turn").limit(n)


def walk_end(walked: DataFrame, size: int, cursor: int, n: int) -> DataFrame:
    """(cursor): behind the n-th due row; a walk that met fewer went around once and ends where it began."""
    past = F.when(F.count(F.lit(1)) >= n, F.pmod(F.max("turn") + 1 + cursor, F.lit(size)))
    return walked.agg(F.coalesce(past, F.lit(cursor)).cast("long").alias("cursor"))


def drain(cache: DataFrame, at: str, harvested: str, as_of: Column, ttl: float, key: str) -> DataFrame:
    """Entries not harvested yet and still fresh, oldest first; an entry without a mark counts as harvested."""
    return cache.filter(~F.coalesce(F.col(harvested), F.lit(True)) & fresh(F.col(at), as_of, ttl)).orderBy(at, key)


def consumed(candidates: DataFrame, key: str, position: str, stop: int) -> DataFrame:
    """(key): keys whose candidates were all examined, the pass having stopped before position stop."""
    return candidates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(position).alias("_last")).filter(F.col("_last") < stop).select(key)


def after_first(text: Column, mark: str = ": ") -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def yields(batch: DataFrame, phrase: str, results: DataFrame, note: str) -> DataFrame:
    """(phrase, found): results of each phrase of the batch, by their notes; phrases without any have 0."""
    counts = results.groupBy(after_first(F.col(note)).alias(phrase)).agg(F.count(F.lit(1)).alias("found"))
    return batch.select(phrase).distinct().join(counts, phrase, "left").fillna(0, ["found"])


def since(rows: DataFrame, at: str, cursor: Column) -> DataFrame:
    """Rows later than the cursor; all where it is null."""
    return rows.filter(F.coalesce(F.col(at) > cursor, cursor.isNull()))


def high_water(rows: DataFrame, at: str, cursor: Column) -> DataFrame:
    """(cursor): the latest time read, the old cursor if nothing was."""
    return rows.agg(F.coalesce(F.max(at), cursor).alias("cursor"))


def rejections(rows: DataFrame, host: str) -> DataFrame:
    """(host, rejected): rows of each named host."""
    name = F.trim(F.col(host))
    return rows.filter(name != "").groupBy(name.alias(host)).agg(F.count(F.lit(1)).alias("rejected"))


def new_items(items: DataFrame, source: str, order: list[Column], key: str, cursor: str, most: int) -> DataFrame:
    """Per source the leading items up to the one that the cursor names, at most so many; the order is unique in a source. A source of very many items is walked by ranges."""
    met = F.coalesce((F.col(key) == F.col(cursor)).cast("int"), F.lit(0))
    along = running(items, [source], order, {"_met": ("max", met), "_rn": ("count", F.lit(1))})
    return along.filter((F.col("_met") == 0) & (F.col("_rn") <= most)).drop("_met", "_rn")


def first_item(items: DataFrame, source: str, order: list[Column], key: str) -> DataFrame:
    """(source, cursor): the key of each source's first item, at which the next reading stops."""
    return items.groupBy(source).agg(F.min_by(key, F.struct(*order)).alias("cursor"))


def request_times(rows: DataFrame, key: str, order: list[Column], at: Column, delay: Column, least: int) -> DataFrame:
    """Rows with start, when a limiter lets each request of a key through.

    Request i starts at max(at, start before + delay). With D the running sum of delays that is the
    running maximum of at - D, plus D, so no history is gathered.
    """
    summed = running(rows, [key], order, {"_d": ("sum", F.greatest(F.lit(least), F.coalesce(delay, F.lit(0))))})
    return running(summed, [key], order, {"_m": ("max", at - F.col("_d"))}).withColumn("start", F.col("_m") + F.col("_d")).drop("_d", "_m")


def next_pass(now: Column, last_passive: Column, interval: float, hard_factor: float, searchable: Column, wait: Column, most_sleep: float, pause: float, least_pause: float = 5.0) -> Column:
    """(active, passive, sleep) of a scheduling decision.

    Without search the active pass is degraded and the passive one runs when due; with it the passive pass
    runs alone when it is long overdue, else the full active one.
    """
    age = now - last_passive
    due, overdue = F.coalesce(age >= interval, F.lit(True)), F.coalesce(age >= interval * hard_factor, F.lit(False))
    active = F.when(~searchable, "degraded").when(~overdue, "full").otherwise("none")
    sleep = F.when(~searchable, F.least(wait, F.lit(most_sleep))).otherwise(max(pause, least_pause))
    return F.struct(active.alias("active"), F.when(~searchable, due).otherwise(overdue).alias("passive"), sleep.alias("sleep"))


def acquire(accounts: DataFrame, states: DataFrame, platform: str, name: str, position: str, as_of: Column) -> DataFrame:
    """(platform, name): each platform's first account that is neither banned nor cooling down. An account without state is usable."""
    held = (F.col("state") == "banned") | ((F.col("state") == "cooldown") & (F.col("until") > as_of))
    usable = accounts.join(states.select(name, "state", "until"), name, "left").filter(~F.coalesce(held, F.lit(False)))
    return usable.groupBy(platform).agg(F.min_by(name, position).alias(name))


def outside_cooldown(rows: DataFrame, seen: str, as_of: Column, seconds: float) -> DataFrame:
    """Rows not seen within so many seconds; 0 lets all through."""
    return rows.filter(~fresh(F.col(seen), as_of, seconds)) if seconds else rows


def pruned(state: DataFrame, score: str, seen: str, as_of: Column, least_score: float, ttl: float) -> DataFrame:
    """State without hosts of a low score that were not seen for ttl seconds."""
    return state.filter(~F.coalesce((F.col(score) < least_score) & (as_of - F.col(seen) >= ttl), F.lit(False)))


def block_due(streak: Column, ever: Column, blocked: Column, crawls: int) -> Column:
    """Whether a host gave offers in so many crawls without own evidence and is not blocked yet."""
    return (streak >= crawls) & ~F.coalesce(ever, F.lit(False)) & ~F.coalesce(blocked, F.lit(False))


def take_skip(state: DataFrame, left: str = "skip_left") -> DataFrame:
    """State after one more pass: skipped tells who sat it out, which uses up one of the skips owed."""
    owes = F.coalesce(F.col(left) > 0, F.lit(False))
    return state.withColumn("skipped", owes).withColumn(left, F.when(F.col("skipped"), F.col(left) - 1).otherwise(F.col(left)))
