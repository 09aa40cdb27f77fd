"""Window functions. Aggregates are totals of the whole partition, whatever its order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import INT

RANKINGS = ("ROW_NUMBER", "RANK", "DENSE_RANK")


def directed(keys: list[tuple[Column, bool]]) -> list[Column]:
    """NULL is smallest: first when ascending, last when descending."""
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]


def ranking(name: str, partition: list[Column], order: list[tuple[Column, bool]], ties: list[Column]) -> Column:
    """Without an order all rows are peers; row numbers then, and among peers, go by insert order."""
    keys = directed(order)
    if name == "ROW_NUMBER":
        keys = [*keys, *ties]
    own: WindowSpec = Window.partitionBy(*partition).orderBy(*(keys or [F.lit(1)]))
    return {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[name]().over(own).cast("bigint")


def whole(name: str, value: Column | None, kind: str) -> Column:
    """A total of all rows."""
    if name == "COUNT":
        return F.count(F.lit(1) if value is None else value)
    if name == "SUM":
        return F.coalesce(F.try_sum(value), F.when(F.count(value) == 0, F.lit(0).cast("bigint" if kind == INT else "double")))
    return {"AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](value)


def total(name: str, value: Column | None, partition: list[Column], kind: str) -> Column:
    own = Window.partitionBy(*partition)
    if name == "SUM":
        return F.coalesce(F.try_sum(value).over(own), F.when(F.count(value).over(own) == 0, F.lit(0).cast("bigint" if kind == INT else "double")))
    return whole(name, value, kind).over(own)
