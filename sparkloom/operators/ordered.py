"""Numbers and running values along an order, where one group may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: A group of at most so many rows is walked by one task; larger ones are cut into ranges of the order.
GROUP_ROWS = 1_000_000

_COMBINED = {"sum": F.sum, "max": F.max, "count": F.count}


def running(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """rows with, for each name in values, the sum, max or count of a column over the rows of the group so far.

    Rows that tie in the order have equal ranks only if the order leaves them equal; make
    it unique. If a group has more than GROUP_ROWS rows, rows are dealt by ranges of group
    and order; a range continues at most one group of the ranges before, so what is
    carried over is one row a range, and is broadcast.
    """
    end = Window.currentRow if inclusive else -1
    most = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= GROUP_ROWS:
        along = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.select("*", *(_COMBINED[kind](c).over(along).alias(name) for name, (kind, c) in values.items()))
    given = rows.select("*", *(c.alias(f"_v_{name}") for name, (_, c) in values.items()))
    ranged = written(given.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    per = ranged.groupBy(*group, "_range").agg(*(_COMBINED[kind](f"_v_{name}").alias(f"_p_{name}") for name, (kind, _) in values.items()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda kind: F.sum if kind == "count" else _COMBINED[kind]
    bases = per.select(*group, "_range", F.count(F.lit(1)).over(before).alias("_earlier"), *(over(kind)(f"_p_{name}").over(before).alias(f"_b_{name}") for name, (kind, _) in values.items()))
    bases = bases.filter("_earlier > 0").drop("_earlier")
    bases = bases.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_g_range"), *(f"_b_{name}" for name in values))
    along = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    found = ranged.select("*", *(_COMBINED[kind](f"_v_{name}").over(along).alias(f"_r_{name}") for name, (kind, _) in values.items()))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_g_{g}")), group, F.col("_range") == F.col("_g_range"))
    found = found.join(F.broadcast(bases), same, "left")

    def joined(name: str, kind: str) -> Column:
        own, base = F.col(f"_r_{name}"), F.col(f"_b_{name}")
        if kind == "max":
            return F.greatest(own, base)
        return F.when(base.isNull(), own).when(own.isNull(), base).otherwise(own + base)

    return found.select(*rows.columns, *(joined(name, kind).alias(name) for name, (kind, _) in values.items()))


def numbered(rows: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """rows with their number along a unique order: numbered within ranges of it, behind the rows of the ranges before."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    bases = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    found = ranged.withColumn("_i", within).join(F.broadcast(bases), "_range")
    return found.select(*rows.columns, (F.col("_base") + F.col("_i") - 1 + start).alias(name))
