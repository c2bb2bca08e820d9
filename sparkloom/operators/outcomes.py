"""Writes that say what they did: counts are observed while the rows are written, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import written


def counted(df: DataFrame, outcome: str, outcomes: list[str], name: str) -> tuple[DataFrame, dict[str, int]]:
    """df written, without its column outcome, and how many of its rows had each of the outcomes."""
    seen = Observation(f"{name}-outcomes")
    observed = df.observe(seen, *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))
    return written(observed.drop(outcome), name), {o: seen.get[o] for o in outcomes}


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], may_change: Column | None = None, outcome: str = "outcome") -> DataFrame:
    """upserts.merge with the outcome of each row: inserted, updated, kept (there was an incoming row that may not change it) or untouched."""
    values = [c for c in current.columns if c not in keys]
    theirs = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_in"))
    ours = current.withColumn("_may", F.coalesce(may_change if may_change is not None else F.lit(True), F.lit(False))).withColumn("_old", F.lit(True))
    both = ours.join(theirs, keys, "full_outer")
    said = F.when(F.col("_old").isNull(), "inserted").when(F.col("_in").isNull(), "untouched").when(F.col("_may"), "updated").otherwise("kept")
    use = said.isin("inserted", "updated")
    return both.select(*keys, *(F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values), said.alias(outcome)).select(*current.columns, outcome)


def reject(items: DataFrame, ids: DataFrame, key: str, status: str, host: str, allowed_from: list[str], outcome: str = "outcome", rejected: str = "rejected") -> tuple[DataFrame, DataFrame]:
    """Items with the ids rejected where their status allows it, with the outcome of each (rejected, refused or untouched), and the hosts to learn
    from: (host, n, total, last), how many items of each host were rejected now, how many of all its items are, and the last such key.

    Ids that repeat count once; ids that no item has change nothing.
    """
    asked = ids.select(key).distinct().withColumn("_asked", F.lit(True))
    both = items.join(asked, key, "left")
    may = F.coalesce(F.col(status).isin(*allowed_from), F.lit(False))
    said = F.when(F.col("_asked").isNull(), "untouched").when(may, "rejected").otherwise("refused")
    done = both.withColumn(outcome, said).withColumn(status, F.when(F.col(outcome) == "rejected", rejected).otherwise(F.col(status))).drop("_asked")
    now = F.col(outcome) == "rejected"
    learnt = done.filter(F.col(host).isNotNull() & (F.trim(host) != "")).groupBy(host).agg(F.count_if(now).alias("n"), F.count_if(F.col(status) == rejected).alias("total"), F.max(F.when(now, F.col(key))).alias("last"))
    return done, learnt.filter("n > 0")
