"""Faceted search over items with child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_filter(items: DataFrame, key: str, equal: dict[str, object] | None = None, within: dict[str, list] | None = None, children: list[tuple[DataFrame, str, str, list]] | None = None, text: str | None = None, text_columns: tuple[str, ...] = (), valid_until: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Items that pass every given filter; a filter that is None or empty does not count.

    children are (table, its item key, column, wanted values): an item passes if any
    child has a wanted value. text is matched in any of the columns, ignoring case,
    with % and _ as in LIKE. valid_until passes if it is null or not before as_of.
    """
    for column, value in (equal or {}).items():
        if value is not None:
            items = items.filter(F.col(column) == value)
    for column, values in (within or {}).items():
        if values:
            items = items.filter(F.col(column).isin(*values))
    if valid_until and as_of is not None:
        items = items.filter(F.col(valid_until).isNull() | (F.col(valid_until) >= as_of))
    if text:
        match = F.lit(False)
        for column in text_columns:
            match = match | F.col(column).ilike(f"%{text}%")
        items = items.filter(match)
    for child, child_key, column, values in children or []:
        if values:
            wanted = child.filter(F.col(column).isin(*values)).select(F.col(child_key).alias("_key"))
            items = items.join(wanted, items[key] == F.col("_key"), "left_semi")
    return items


def page(items: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of at most size rows; order must be total."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def with_children(items: DataFrame, key: str, child: DataFrame, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Items with an array of their children in the order of the fields; a page should be cut first."""
    own = child.join(items.select(F.col(key).alias(child_key)).distinct(), child_key, "left_semi")
    gathered = own.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return items.join(gathered, key, "left")
