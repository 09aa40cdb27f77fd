"""Links. Equalities in a condition become join keys; Spark picks the algorithm from sizes, at run time too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def link(left: DataFrame, right: DataFrame, kind: str, on: Column | None) -> DataFrame:
    """Inner, left, right, full or cross. A NULL key links with nothing."""
    if kind == "cross":
        return left.crossJoin(right)
    return left.join(right, on, kind)
