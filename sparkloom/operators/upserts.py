"""New snapshots of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], may_change: Column | None = None) -> DataFrame:
    """current with incoming rows inserted, and updated where may_change, a condition on current columns, holds. Keys are unique in both."""
    values = [c for c in current.columns if c not in keys]
    theirs = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_in"))
    ours = current.withColumn("_may", F.coalesce(may_change if may_change is not None else F.lit(True), F.lit(False))).withColumn("_old", F.lit(True))
    both = ours.join(theirs, keys, "full_outer")
    use = F.col("_in").isNotNull() & (F.col("_old").isNull() | F.col("_may"))
    return both.select(*keys, *(F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values)).select(current.columns)


def insert_missing(current: DataFrame, incoming: DataFrame, key: Column) -> DataFrame:
    """current and of incoming the rows with a new computed key, the first by column order of each."""
    new = incoming.withColumn("_k", key).join(current.select(key.alias("_k")).distinct(), "_k", "left_anti")
    first = new.groupBy("_k").agg(F.min(F.struct(*incoming.columns)).alias("x")).select("x.*")
    return current.unionByName(first.select(current.columns))


def patch(current: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update: patches has key and, for each column c, c and set_c, whether c is given."""
    p = patches.select(key, *(F.struct(f"set_{c}", c).alias(f"_{c}") for c in columns))
    both = current.join(p, key, "left")
    changed = [F.when(F.coalesce(F.col(f"_{c}")[f"set_{c}"], F.lit(False)), F.col(f"_{c}")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns]
    return both.select(*changed)


def split_known(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ids with whether the table has them."""
    return ids.join(table.select(key).distinct().withColumn("known", F.lit(True)), key, "left").fillna(False, ["known"])


def orphan(children: DataFrame, foreign_key: str, deleted: DataFrame, key: str) -> DataFrame:
    """children whose parent is deleted lose the reference."""
    gone = deleted.select(F.col(key).alias(foreign_key)).distinct().withColumn("_gone", F.lit(True))
    j = children.join(gone, foreign_key, "left")
    return j.withColumn(foreign_key, F.when(F.col("_gone").isNull(), F.col(foreign_key))).select(children.columns)


def transition(rows: DataFrame, status: str, allowed_from: list[str], to: str, chosen: Column) -> DataFrame:
    """Chosen rows in an allowed state change to the new one; all others stay."""
    return rows.withColumn(status, F.when(F.coalesce(chosen, F.lit(False)) & F.col(status).isin(*allowed_from), to).otherwise(F.col(status)))
