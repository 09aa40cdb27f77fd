"""Names, types and queries: syntax trees to lazy DataFrames.

Every column of every source gets a name that is unique in the statement when it is scanned, so self-joins, names that
differ in case only and equal names under ``*`` need no care later; names are put back by the last projection. Nothing
here runs a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticFault
from ..functions import scalar
from ..functions.scalar import BOOL, FLOAT, INT, NULL, TEXT, TIME
from ..operators import grouping, joins, ordering, windows
from . import syntax as S
from .bounds import Bounds, bounds

#: The hidden insert ordinal of the engine's own tables.
ROW_ID = "__rid"


@dataclass
class Relation:
    """What a source name stands for: rows, and (name, type) of its columns in order. ``row_id`` may be among the columns
    of ``frame`` beyond those."""

    frame: DataFrame
    columns: list[tuple[str, str]]
    has_row_id: bool = False


@dataclass
class Bound:
    """A source inside a statement: its columns by name, as (unique name, type)."""

    name: str
    columns: dict[str, tuple[str, str]]
    row_id: str | None = None


@dataclass
class Scope:
    sources: list[Bound]
    outer: Scope | None = None


@dataclass
class Compiled:
    frame: DataFrame  # columns are named c0, c1, ...
    names: list[str]
    types: list[str]
    order: list = field(default_factory=list)

    def named(self) -> DataFrame:
        return self.frame.toDF(*self.names)


class Compiler:
    """Compiles one statement. ``resolve(name, as_of, bounds)`` gives the relation of a name, or None; rows beyond the bounds
    of their columns may be missing in it."""

    def __init__(self, resolve: Callable[..., Relation | None]):
        self.resolve = resolve
        self._numbers = count()

    # Names

    def bind(self, source: S.Source, as_of: int | None, where: Bounds | None = None) -> tuple[DataFrame, Bound]:
        relation = self.resolve(source.table, as_of, where)
        if relation is None:
            raise SemanticFault(f"unknown table '{source.table}'")
        return self.bind_relation(relation, source.alias or source.table)

    def bind_relation(self, relation: Relation, name: str) -> tuple[DataFrame, Bound]:
        number = next(self._numbers)
        columns, picked = {}, []
        for i, (column, kind) in enumerate(relation.columns):
            unique = f"s{number}_{i}"
            picked.append(F.col(f"`{relation.frame.columns[i]}`").alias(unique))
            columns[column] = (unique, kind)
        row_id = None
        if relation.has_row_id:
            row_id = f"s{number}_rid"
            picked.append(F.col(ROW_ID).alias(row_id))
        return relation.frame.select(*picked), Bound(name, columns, row_id)

    def find(self, name: S.Name, scope: Scope) -> tuple[Column, str]:
        at, outer = scope, False
        while at is not None:
            fits = [s for s in at.sources if name.table is None or s.name == name.table]
            owners = [s for s in fits if name.column in s.columns]
            if len(owners) > 1:
                raise SemanticFault(f"ambiguous column '{name.column}'")
            if owners:
                unique, kind = owners[0].columns[name.column]
                column = F.col(unique)
                return (column.outer() if outer else column), kind
            if fits and name.table is not None and at.outer is None:
                raise SemanticFault(f"unknown column '{name.column}' in table '{name.table}'")
            at, outer = at.outer, True
        if name.table is not None:
            raise SemanticFault(f"unknown table qualifier '{name.table}'")
        where = f" in table '{scope.sources[0].name}'" if len(scope.sources) == 1 else ""
        raise SemanticFault(f"unknown column '{name.column}'{where}")

    # Expressions

    def condition(self, e: Any, scope: Scope, known: dict | None = None) -> Column:
        column, kind = self.expression(e, scope, known)
        if kind not in (BOOL, NULL):
            raise SemanticFault("a condition must be boolean")
        return column.cast("boolean") if kind == NULL else column

    def expression(self, e: Any, scope: Scope, known: dict | None = None) -> tuple[Column, str]:
        """(column, type). ``known`` has columns that stand for whole expressions: aggregates after grouping."""
        if known is not None and e in known:
            return known[e]
        more = lambda x: self.expression(x, scope, known)
        match e:
            case S.Literal(v):
                return self.literal(v)
            case S.Name():
                return self.find(e, scope)
            case S.Arith(op, a, b):
                (x, p), (y, q) = more(a), more(b)
                if not {p, q} <= {INT, FLOAT, NULL}:
                    raise SemanticFault("arithmetic operator requires numeric operands")
                kind = FLOAT if FLOAT in (p, q) else INT
                return scalar.arithmetic(op, scalar.as_type(x, p, kind), scalar.as_type(y, q, kind), kind), kind
            case S.Compare(op, a, b):
                x, y = self.comparable(more(a), more(b), "type mismatch in comparison")
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL
            case S.Logic(op, a, b):
                x, y = self.condition(a, scope, known), self.condition(b, scope, known)
                return (x & y) if op == "AND" else (x | y), BOOL
            case S.Not(a):
                return ~self.condition(a, scope, known), BOOL
            case S.IsNull(a, negated):
                x, _ = more(a)
                return x.isNotNull() if negated else x.isNull(), BOOL
            case S.Between(a, low, high, negated):
                value = more(a)
                x, y = self.comparable(value, more(low), "type mismatch in BETWEEN")
                z, w = self.comparable(value, more(high), "type mismatch in BETWEEN")
                inside = (x >= y) & (z <= w)
                return ~inside if negated else inside, BOOL
            case S.Like(a, pattern, negated):
                (x, p), (y, q) = more(a), more(pattern)
                if not {p, q} <= {TEXT, NULL}:
                    raise SemanticFault("LIKE requires a text operand")
                own = pattern.value if isinstance(pattern, S.Literal) and isinstance(pattern.value, str) else None
                found = scalar.like(x.cast("string"), y.cast("string"), own)
                return ~found if negated else found, BOOL
            case S.In(a, items, None, negated):
                value = more(a)
                pairs = [self.comparable(value, self.literal(i.value), "type mismatch in IN list") for i in items]
                found = pairs[0][0].isin(*(y for _, y in pairs)) if len({str(x) for x, _ in pairs}) == 1 else _any(x == y for x, y in pairs)
                return ~found if negated else found, BOOL
            case S.In(a, None, query, negated):
                value, inner = more(a), self.fetch(query, scope)
                x, y = self.comparable(value, (F.col("c0"), inner.types[0]), "type mismatch in IN list")
                if negated:
                    same, some, null = self._members(a, query, scope)
                    return F.when(same, False).when(null | (x.isNull() & some), F.lit(None).cast("boolean")).otherwise(True), BOOL
                return x.isin(inner.frame.select(y.alias("c0"))), BOOL
            case S.Subquery(query, exists):
                inner = self.fetch(query, scope)
                if exists:
                    return inner.frame.exists(), BOOL
                one = inner.frame.select("c0")
                # The first row's value; a lone aggregate has one row, and Spark decorrelates it without a limit.
                return (one if _one_row(query) else one.limit(1)).scalar(), inner.types[0]
            case S.Case(branches, otherwise):
                values = [more(v) for _, v in branches] + [more(otherwise) if otherwise is not None else self.literal(None)]
                kind = scalar.common_type([k for _, k in values])
                if kind is None:
                    raise SemanticFault("type mismatch in CASE")
                found = F
                for (c, _), (v, k) in zip(branches, values, strict=False):
                    found = found.when(self.condition(c, scope, known), scalar.as_type(v, k, kind))
                return found.otherwise(scalar.as_type(*values[-1], kind)), kind
            case S.Cast(a, to):
                x, p = more(a)
                to = to if to in (INT, FLOAT, BOOL) else TEXT
                return scalar.cast(x, p, to), to
            case S.Call(name, arguments):
                if name not in scalar.ARITY:
                    raise SemanticFault(f"unknown function '{name.lower()}'")
                return scalar.call(name, [more(a) for a in arguments], _raise)
            case S.Aggregate(name, _, _):
                raise SemanticFault(f"{name} is not allowed here")
            case S.Window():
                raise SemanticFault("a window function must be a whole item of the FETCH list")
        raise SemanticFault(f"unsupported expression {type(e).__name__}")

    def _members(self, a: Any, query: Any, scope: Scope) -> tuple[Column, Column, Column]:
        """Whether a query has the value of ``a``, any row, and a NULL: what NOT IN depends on.

        Spark's own NOT IN broadcasts the whole query, whatever its size; an equality becomes a join of any kind.
        """
        inner, again, null = (self.fetch(query, scope) for _ in range(3))
        x, y = self.comparable(self.expression(a, Scope([], scope)), (F.col("c0"), inner.types[0]), "type mismatch in IN list")
        return inner.frame.where(x == y).exists(), again.frame.exists(), null.frame.where(F.col("c0").isNull()).exists()

    def filtered(self, frame: DataFrame, when: Any, scope: Scope) -> DataFrame:
        """Rows for which the condition is true. NOT IN of a query, as a condition of its own, is an anti join."""
        match when:
            case S.Logic("AND", a, b):
                return self.filtered(self.filtered(frame, a, scope), b, scope)
            case S.In(a, None, query, True):
                same, some, null = self._members(a, query, scope)
                return frame.where(~same).where(~null).where(self.expression(a, scope)[0].isNotNull() | ~some)
        return frame.where(self.condition(when, scope))

    def literal(self, v: Any) -> tuple[Column, str]:
        if v is None:
            return F.lit(None), NULL
        if isinstance(v, bool):
            return F.lit(v), BOOL
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise SemanticFault(f"integer {v} is out of range")
            return F.lit(v).cast("bigint"), INT
        return (F.lit(v), FLOAT) if isinstance(v, float) else (F.lit(v), TEXT)

    def comparable(self, a: tuple[Column, str], b: tuple[Column, str], text: str) -> tuple[Column, Column]:
        (x, p), (y, q) = a, b
        if NULL in (p, q):
            return x, y
        if {p, q} == {TEXT, TIME}:  # a text beside a time is read as one
            return (x.try_cast("timestamp_ntz") if p == TEXT else x), (y.try_cast("timestamp_ntz") if q == TEXT else y)
        if p != q and not {p, q} <= {INT, FLOAT}:
            raise SemanticFault(f"{text}: {p} vs {q}" if "comparison" in text else text)
        kind = scalar.common_type([p, q])
        return scalar.as_type(x, p, kind), scalar.as_type(y, q, kind)

    # Queries

    def query(self, q: Any) -> Compiled:
        if isinstance(q, S.SetOperation):
            left, right = self.query(q.left), self.fetch(q.right, None)
            if len(left.names) != len(right.names):
                raise SemanticFault("set operation requires matching column counts")
            kinds = [scalar.common_type([p, q]) for p, q in zip(left.types, right.types, strict=True)]
            if None in kinds:
                raise SemanticFault("set operation requires matching column types")
            sides = [side.frame.select(*(scalar.as_type(F.col(c), p, k).alias(c) for c, p, k in zip(side.frame.columns, side.types, kinds, strict=True))) for side in (left, right)]
            return Compiled(ordering.combine(q.op, *sides), left.names, kinds)
        return self.fetch(q, None)

    def fetch(self, q: S.Fetch, outer: Scope | None) -> Compiled:
        frame, scope = self.sources(q, outer)
        if q.when is not None:
            frame = self.filtered(frame, q.when, scope)
        items = self.items(q, scope)
        if any(isinstance(i.value, S.Window) for i in items):
            return self.windowed(q, frame, scope, items)
        if q.group or q.having is not None or any(_aggregates(i.value) for i in items):
            return self.grouped(q, frame, scope, items)
        return self.finished(q, frame, [(i, *self.expression(i.value, scope)) for i in items], [(self.find(k.column, scope)[0], k.ascending) for k in q.sort], scope)

    def sources(self, q: S.Fetch, outer: Scope | None) -> tuple[DataFrame, Scope]:
        where = lambda s: bounds(q.when, s.alias or s.table, not q.links)
        frame, first = self.bind(q.source, q.source.as_of, where(q.source))
        scope = Scope([first], outer)
        for link in q.links:
            right, bound = self.bind(link.source, q.source.as_of, where(link.source))
            if any(s.name == bound.name for s in scope.sources):
                raise SemanticFault(f"table name '{bound.name}' is used twice; give it an alias")
            scope = Scope([*scope.sources, bound], outer)
            on = None if link.on is None else self.condition(link.on, scope)
            frame = joins.link(frame, right, link.kind, on)
        return frame, scope

    def items(self, q: S.Fetch, scope: Scope) -> list[S.Item]:
        if q.items is not None:
            return list(q.items)
        return [S.Item(S.Name(s.name, c), c) for s in scope.sources for c in s.columns]

    def item_name(self, item: S.Item) -> str:
        if item.alias is not None:
            return item.alias
        return item.value.column if isinstance(item.value, S.Name) else S.shown(item.value)

    def finished(self, q: S.Fetch, frame: DataFrame, made: list[tuple[S.Item, Column, str]], sort: list[tuple[Column, bool]], scope: Scope) -> Compiled:
        """Sorts, projects, removes repeated rows, skips and takes, in this order."""
        ties = [F.col(s.row_id) for s in scope.sources if s.row_id]
        values = [(c.cast("string") if k == NULL else c).alias(f"c{i}") for i, (_, c, k) in enumerate(made)]
        frame = ordering.arrange(frame, values, sort, ties, q.unique, q.take, q.skip)
        return Compiled(frame, [self.item_name(i) for i, _, _ in made], [k for _, _, k in made])

    def grouped(self, q: S.Fetch, frame: DataFrame, scope: Scope, items: list[S.Item]) -> Compiled:
        wanted: dict[S.Aggregate, None] = {}
        for e in [*(i.value for i in items), *([q.having] if q.having is not None else [])]:
            wanted |= dict.fromkeys(_aggregates(e))
        keys = [(g, *self.find(g, scope)) for g in q.group]
        groups = {str(c): None for _, c, _ in keys}
        known: dict[Any, tuple[Column, str]] = {}
        aggregates: list[Column] = []
        for a in wanted:
            column, kind = self.aggregate(a, scope)
            name = f"a{next(self._numbers)}"
            aggregates.append(column.alias(name))
            known[a] = (F.col(name), kind)
        # A column outside the groups has the value of the group's first row.
        plain: dict[S.Name, None] = {}
        for e in [*(i.value for i in items), *([q.having] if q.having is not None else []), *(k.column for k in q.sort)]:
            plain |= dict.fromkeys(_names(e))
        aliases = {i.alias: i.value for i in items if i.alias}
        first = next((s.row_id for s in scope.sources if s.row_id), None)
        for n in plain:
            if n.table is None and n.column in aliases and not any(n.column in s.columns for s in scope.sources):
                continue
            column, kind = self.find(n, scope)
            if str(column) not in groups and not _is_outer(n, scope):
                name = f"a{next(self._numbers)}"
                aggregates.append(grouping.first_value(column, first).alias(name))
                known[n] = (F.col(name), kind)
        frame = grouping.group(frame, [c for _, c, _ in keys], aggregates)
        if q.having is not None:
            frame = frame.where(self.condition(q.having, scope, known))
        ordered = [i for i in items if not isinstance(i.value, S.Aggregate)] + [i for i in items if isinstance(i.value, S.Aggregate)]
        made = [(i, *self.expression(i.value, scope, known)) for i in ordered]
        sort = []
        for k in q.sort:
            target = aliases[k.column.column] if k.column.table is None and k.column.column in aliases and not any(k.column.column in s.columns for s in scope.sources) else k.column
            sort.append((self.expression(target, scope, known)[0], k.ascending))
        return self.finished(q, frame, made, sort, Scope([], scope.outer))

    def aggregate(self, a: S.Aggregate, scope: Scope) -> tuple[Column, str]:
        if a.argument is None:
            if a.name != "COUNT" or a.unique:
                raise SemanticFault(f"{a.name}({'UNIQUEONLY ' if a.unique else ''}*) is not allowed")
            return F.count(F.lit(1)), INT
        if list(_aggregates(a.argument)):
            raise SemanticFault("aggregates can't be nested")
        column, kind = self.expression(a.argument, scope)
        if a.name in ("SUM", "AVG") and kind not in (INT, FLOAT):
            raise SemanticFault(f"{a.name} requires a numeric column")
        return grouping.aggregate(a.name, column, a.unique), INT if a.name == "COUNT" else FLOAT if a.name == "AVG" else kind

    def windowed(self, q: S.Fetch, frame: DataFrame, scope: Scope, items: list[S.Item]) -> Compiled:
        if q.group or q.having is not None or any(_aggregates(i.value) for i in items):
            raise SemanticFault("a window function can't stand beside GROUP BY, HAVING or aggregates")
        ties = [F.col(s.row_id) for s in scope.sources if s.row_id]
        made = []
        for n, i in enumerate(items):
            if not isinstance(i.value, S.Window):
                made.append((i, *self.expression(i.value, scope)))
                continue
            w = i.value
            partition = [self.find(c, scope)[0] for c in w.partition]
            order = [(self.find(k.column, scope)[0], k.ascending) for k in w.order]
            if w.name in windows.RANKINGS:
                column, kind = windows.ranking(w.name, partition, order, ties), INT
            elif w.name in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
                value, kind = (None, INT) if w.argument is None else self.expression(w.argument, scope)
                if value is None and w.name != "COUNT":
                    raise SemanticFault(f"{w.name}(*) is not allowed")
                if w.name in ("SUM", "AVG") and kind not in (INT, FLOAT):
                    raise SemanticFault(f"{w.name} requires a numeric column")
                if not partition and scope.outer is None:  # one row beside all others, in place of all rows in one task
                    name = f"w{next(self._numbers)}_{n}"
                    one = frame.agg(windows.whole(w.name, value, kind).alias(name))
                    frame = frame.crossJoin(F.broadcast(one))
                    made.append((i, F.col(name), INT if w.name == "COUNT" else FLOAT if w.name == "AVG" else kind))
                    continue
                column = windows.total(w.name, value, partition, kind)
                kind = INT if w.name == "COUNT" else FLOAT if w.name == "AVG" else kind
            else:
                raise SemanticFault(f"unknown window function '{w.name.lower()}'")
            name = f"w{next(self._numbers)}_{n}"
            frame = frame.withColumn(name, column)
            made.append((i, F.col(name), kind))
        return self.finished(q, frame, made, [(self.find(k.column, scope)[0], k.ascending) for k in q.sort], scope)


def _raise(text: str) -> None:
    raise SemanticFault(text)


def _any(conditions) -> Column:
    found = None
    for c in conditions:
        found = c if found is None else found | c
    return found


def _children(e: Any) -> list[Any]:
    match e:
        case S.Compare(_, a, b) | S.Logic(_, a, b) | S.Arith(_, a, b):
            return [a, b]
        case S.Not(a) | S.IsNull(a, _) | S.Cast(a, _) | S.In(a, _, _, _):
            return [a]
        case S.Between(a, b, c, _):
            return [a, b, c]
        case S.Like(a, b, _):
            return [a, b]
        case S.Call(_, arguments):
            return list(arguments)
        case S.Case(branches, otherwise):
            return [x for pair in branches for x in pair] + ([otherwise] if otherwise is not None else [])
    return []


def _aggregates(e: Any) -> list[S.Aggregate]:
    return [e] if isinstance(e, S.Aggregate) else [x for c in _children(e) for x in _aggregates(c)]


def _names(e: Any) -> list[S.Name]:
    """Column names outside aggregates."""
    return [e] if isinstance(e, S.Name) else [x for c in _children(e) for x in _names(c)]


def _is_outer(n: S.Name, scope: Scope) -> bool:
    return not any((n.table is None or s.name == n.table) and n.column in s.columns for s in scope.sources)


def _one_row(q: S.Fetch) -> bool:
    return not q.group and q.having is None and q.items is not None and any(_aggregates(i.value) for i in q.items) and q.take is None and not q.skip
