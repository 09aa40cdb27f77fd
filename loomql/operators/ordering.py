"""Order, distinct rows, limits, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import directed


def arrange(frame: DataFrame, values: list[Column], sort: list[tuple[Column, bool]], ties: list[Column], unique: bool, take: int | None, skip: int) -> DataFrame:
    """Rows sorted, projected to ``values`` (c0, c1, ...), distinct, skipped and taken.

    Of equal rows the first in sorted order counts. A sort with a limit and no distinct becomes a top-k; ties go by
    insert order where rows have one.
    """
    names = [f"c{i}" for i in range(len(values))]
    keys = [f"k{i}" for i in range(len(sort))]
    if unique and not sort:
        frame = frame.select(*values).distinct()
    elif unique:
        made = frame.select(*values, *(c.alias(k) for (c, _), k in zip(sort, keys, strict=True)))
        order = directed([(F.col(k), up) for k, (_, up) in zip(keys, sort, strict=True)])
        nth = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
        frame = made.withColumn("nth", nth).where("nth = 1").orderBy(*order).select(*names)
    elif sort:
        made = frame.select(*values, *(c.alias(k) for (c, _), k in zip(sort, keys, strict=True)), *(t.alias(f"t{i}") for i, t in enumerate(ties)))
        order = directed([(F.col(k), up) for k, (_, up) in zip(keys, sort, strict=True)]) + [F.col(f"t{i}") for i in range(len(ties))]
        return limited(made.orderBy(*order), take, skip).select(*names)
    else:
        frame = frame.select(*values)
    return limited(frame, take, skip)


def limited(frame: DataFrame, take: int | None, skip: int) -> DataFrame:
    if skip:
        frame = frame.offset(skip)
    return frame if take is None else frame.limit(take)


def combine(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    if op == "UNION ALL":
        return left.union(right)
    if op == "UNION":
        return left.union(right).distinct()
    return left.intersect(right) if op == "INTERSECT" else left.subtract(right)
