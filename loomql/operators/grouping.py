"""Grouping: partial aggregates before the shuffle, final ones after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(name: str, value: Column, unique: bool) -> Column:
    if name == "COUNT":
        return F.count_distinct(value) if unique else F.count(value)
    if name == "SUM":
        return F.sum_distinct(value) if unique else F.try_sum(value)  # a sum beyond 64 bits is NULL
    if name == "AVG":
        # Each distinct value counts once: their sum over their number.
        return F.try_divide(F.sum_distinct(value.cast("double")), F.count_distinct(value).cast("double")) if unique else F.avg(value)
    return F.min(value) if name == "MIN" else F.max(value)


def first_value(value: Column, row_id: str | None) -> Column:
    """The value in the group's first row, by insert order where rows have one."""
    return F.min_by(F.struct(value.alias("v")), F.col(row_id))["v"] if row_id else F.first(value)


def group(frame: DataFrame, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """One row per group; without keys, one row even of no input. The keys keep their names."""
    if not keys:
        # A projection of aggregates stays lazy where it refers to an outer query; agg() would be analysed at once.
        return frame.select(*(aggregates or [F.count(F.lit(1)).alias("one")]))
    return frame.groupBy(*keys).agg(*aggregates) if aggregates else frame.select(*keys).distinct()
