"""Constraints on written rows. Each statement's row checks are one aggregation; keys are compared by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RuntimeFault
from ..plans.compiler import Compiler, Relation, Scope
from ..plans.parser import parse_expression
from ..sources.catalog import SEEN


def check_rows(name: str, table: dict, rows: DataFrame) -> None:
    """NOT NULL, VARCHAR lengths and CHECK (which a NULL fails) of rows with physical columns."""
    rules: list[tuple[str, object]] = []
    key = set(table["primary_key"])
    relation = Relation(rows.select(*(c["id"] for c in table["columns"])), [(c["name"], SEEN[c["type"]]) for c in table["columns"]])
    compiler = Compiler(lambda *_: None)
    frame, bound = compiler.bind_relation(relation, name)
    for c in table["columns"]:
        value = F.col(bound.columns[c["name"]][0])
        if c["not_null"] or c["name"] in key:
            rules.append((f"NOT NULL constraint failed: {name}.{c['name']}", value.isNull()))
        if c["length"] is not None:
            rules.append((f"value too long for column '{c['name']}' (max {c['length']})", F.octet_length(value) > c["length"]))
        if c["check"]:
            rules.append((f"CHECK constraint failed: {name}.{c['name']}", ~F.coalesce(compiler.condition(parse_expression(c["check"]), Scope([bound])), F.lit(False))))
    if rules:
        broken = frame.agg(*(F.max(F.coalesce(r, F.lit(False)).cast("int")) for _, r in rules)).first()
        for (text, _), found in zip(rules, broken, strict=True):
            if found:
                raise RuntimeFault(text)


def check_keys(name: str, table: dict, changed: DataFrame, others: Callable[[list[str]], DataFrame]) -> None:
    """UNIQUE and PRIMARY KEY: changed rows among themselves and against all others. NULLs are never equal.

    ``others(ids)`` are all other rows that may have the values of changed rows in these columns.
    """
    keys = [([c], f"UNIQUE constraint failed: {name}.{c['name']}") for c in table["columns"] if c["unique"]]
    if table["primary_key"]:
        keys.append(([c for n in table["primary_key"] for c in table["columns"] if c["name"] == n], f"PRIMARY KEY constraint failed: {name}"))
    for columns, text in keys:
        ids = [c["id"] for c in columns]
        mine = changed.select(*ids).dropna()
        found = mine.unionByName(others(ids).select(*ids).join(mine, ids, "left_semi")).groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not found.isEmpty():
            raise RuntimeFault(text)


def check_references(table: dict, changed: DataFrame, parent_rows) -> None:
    """Every non-NULL value of a referring column is in its parent; ``parent_rows(table, column)`` has the parent's values."""
    for c in table["columns"]:
        if c["reference"]:
            parent, column = c["reference"]["table"], c["reference"]["column"]
            mine = changed.select(F.col(c["id"]).alias("v")).dropna().distinct()
            if not mine.join(parent_rows(parent, column), "v", "left_anti").isEmpty():
                raise RuntimeFault(f"foreign key violation: value not present in {parent}({column})")
