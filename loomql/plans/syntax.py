"""Syntax trees: plain data, made by the parser and never changed."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # int, float, bool, str or None


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR
    left: Any
    right: Any


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    operand: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool


@dataclass(frozen=True)
class In:
    value: Any
    items: tuple | None
    query: Any | None
    negated: bool


@dataclass(frozen=True)
class Between:
    value: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    value: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    argument: Any | None  # None is *
    unique: bool


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class Cast:
    operand: Any
    to: str


@dataclass(frozen=True)
class Case:
    branches: tuple  # of (condition, value)
    otherwise: Any | None


@dataclass(frozen=True)
class SortKey:
    column: Any
    ascending: bool


@dataclass(frozen=True)
class Window:
    name: str
    argument: Any | None
    partition: tuple
    order: tuple


@dataclass(frozen=True)
class Subquery:
    query: Any
    exists: bool


@dataclass(frozen=True)
class Item:
    value: Any
    alias: str | None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None
    as_of: int | None = None


@dataclass(frozen=True)
class Link:
    kind: str  # inner, left, right, full, cross
    source: Source
    on: Any | None


@dataclass(frozen=True)
class Fetch:
    items: tuple | None  # None is *
    source: Source
    links: tuple
    when: Any | None
    group: tuple
    having: Any | None
    sort: tuple
    take: int | None
    skip: int
    unique: bool


@dataclass(frozen=True)
class SetOperation:
    op: str  # UNION, UNION ALL, INTERSECT, EXCEPT
    left: Any
    right: Fetch


@dataclass(frozen=True)
class Explain:
    query: Fetch


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    on_remove: str = "RESTRICT"
    on_modify: str = "RESTRICT"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT, FLOAT, BOOL, TEXT, VARCHAR, DATE, TIMESTAMP
    length: int | None = None
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    auto: bool = False
    default: Literal | None = None
    check: str | None = None
    reference: Reference | None = None


@dataclass(frozen=True)
class BuildRelation:
    name: str
    columns: tuple
    primary_key: tuple


@dataclass(frozen=True)
class BuildFrom:
    name: str
    query: Fetch


@dataclass(frozen=True)
class BuildView:
    name: str
    query: Fetch
    text: str


@dataclass(frozen=True)
class BuildIndex:
    name: str
    table: str
    columns: tuple


@dataclass(frozen=True)
class Discard:
    kind: str  # RELATION, VIEW, INDEX
    name: str


@dataclass(frozen=True)
class Truncate:
    name: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class DiscardColumn:
    table: str
    column: str


@dataclass(frozen=True)
class Conflict:
    columns: tuple
    changes: tuple | None  # of (column, expression); None is DO NOTHING


@dataclass(frozen=True)
class Put:
    table: str
    columns: tuple | None
    rows: tuple | None  # of tuples of Literal
    query: Fetch | None
    conflict: Conflict | None = None
    returning: tuple | None = None  # of column names; () is *


@dataclass(frozen=True)
class Modify:
    table: str
    changes: tuple
    source: Source | None
    when: Any | None
    returning: tuple | None = None


@dataclass(frozen=True)
class Remove:
    table: str
    when: Any | None
    returning: tuple | None = None


@dataclass(frozen=True)
class Transaction:
    kind: str  # START, SAVE, UNDO


@dataclass
class Parsed:
    statement: Any
    text: str = field(default="")


def shown(e: Any) -> str:
    """An expression as text: an item's name where it has no alias, and the form in which checks are kept."""
    match e:
        case Literal(value=None):
            return "NULL"
        case Literal(value=bool() as v):
            return "TRUE" if v else "FALSE"
        case Literal(value=str() as v):
            return "'" + v.replace("'", "''") + "'"
        case Literal(value=float() as v):
            return format(v, "f") if "e" in repr(v) else repr(v)
        case Literal(value=v):
            return str(v)
        case Name(table=None, column=c):
            return c
        case Name(table=t, column=c):
            return f"{t}.{c}"
        case Compare(op, a, b) | Arith(op, a, b) | Logic(op, a, b):
            return f"({shown(a)} {op} {shown(b)})"
        case Not(a):
            return f"(NOT {shown(a)})"
        case IsNull(a, negated):
            return f"({shown(a)} IS {'NOT ' if negated else ''}NULL)"
        case Between(a, low, high, negated):
            return f"({shown(a)} {'NOT ' if negated else ''}BETWEEN {shown(low)} AND {shown(high)})"
        case Like(a, pattern, negated):
            return f"({shown(a)} {'NOT ' if negated else ''}LIKE {shown(pattern)})"
        case In(a, items, query, negated):
            inner = "(subquery)" if query is not None else f"({', '.join(map(shown, items))})"
            return f"({shown(a)} {'NOT ' if negated else ''}IN {inner})"
        case Aggregate(name, argument, unique):
            return f"{name}({'UNIQUEONLY ' if unique else ''}{'*' if argument is None else shown(argument)})"
        case Call(name, arguments):
            return f"{name}({', '.join(map(shown, arguments))})"
        case Cast(a, to):
            return f"CAST({shown(a)} AS {to})"
        case Case(branches, otherwise):
            middle = "".join(f" WHEN {shown(c)} THEN {shown(v)}" for c, v in branches)
            return f"CASE{middle}{'' if otherwise is None else ' ELSE ' + shown(otherwise)} END"
        case Window(name, argument, _, _):
            return f"{name}({'' if argument is None else argument.column}) OVER"
        case Subquery(_, exists):
            return "EXISTS(...)" if exists else "(subquery)"
    raise TypeError(type(e).__name__)
