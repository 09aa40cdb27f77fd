"""Writing statements, as changes to a catalog that isn't committed yet.

A change is found once, as a staged delta: the rows that change, their new and old values, and the part each lies in. Parts
without such a row are kept as they are; the others are written again without them. Inserts only add parts. Parts come with
the ranges of indexed columns and keys, so that statements open only those that may hold what they look for.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import RuntimeFault, SemanticFault

from ..functions.scalar import FLOAT, INT, NULL
from ..plans import syntax as S
from ..plans.bounds import Bounds, bounds
from ..plans.compiler import Bound, Compiler, Relation, Scope
from ..sources.catalog import SEEN, Catalog, checked_literal, parts_of
from ..sources.store import PART, ROW_ID, STORED, stored_schema
from . import constraints

#: A statement that finds this many parts of under SMALL bytes, and adds some, writes them again as one.
MOST_SMALL = 48
SMALL = 32 << 20
#: Longer texts have no ranges.
RANGE_TEXT = 64


class Writer:
    """Applies statements to a working copy of the catalog. ``compiler()`` compiles against that copy."""

    def __init__(self, catalog: Catalog, compiler):
        self.catalog, self.compiler, self.store = catalog, compiler, catalog.store
        self.dirty: set[str] = set()

    # Rows and snapshots

    def _set_parts(self, name: str, parts: list[str]) -> None:
        """The table's uncommitted snapshot; there is one at most."""
        table = self.catalog.table(name)
        own = {"version": None, "columns": table["columns"], "parts": parts}
        if table["snapshots"] and table["snapshots"][-1]["version"] is None:
            table["snapshots"][-1] = own
        else:
            table["snapshots"].append(own)
        self.dirty.add(name)

    def _write(self, name: str, frame: DataFrame) -> list[str]:
        """New parts of a table, with their ranges."""
        made = self.store.write(frame)
        self.catalog.table(name)["files"].update(made)
        self.measure(name, list(made))
        return list(made)

    def _packed(self, name: str, parts: list[str]) -> list[str]:
        """The same rows in few parts: small ones are put together once there are many."""
        table = self.catalog.table(name)
        small = {p for p in parts if table["files"][p]["bytes"] < SMALL}
        if len(small) < MOST_SMALL:
            return parts
        return [*(p for p in parts if p not in small), *self._write(name, self.catalog.read(table, sorted(small), table["columns"]).coalesce(1))]

    def measure(self, name: str, parts: list[str] | None = None) -> None:
        """Gives parts (by default all of every snapshot) the ranges they lack: of indexed columns, keys and automatic numbers."""
        table = self.catalog.table(name)
        wanted = {n for names in self.catalog.index_columns(name) for n in names}
        columns = [c for c in table["columns"] if (c["name"] in wanted or c["auto"]) and c["type"] != "BOOL"]
        parts = list(table["files"]) if parts is None else parts
        parts = [p for p in parts if any(c["id"] not in table["files"][p].get("ranges", {}) for c in columns)]
        if not columns or not parts:
            return
        rows = self.catalog.read(table, parts, columns, with_part=True)
        ends = [f(c["id"]).alias(f"{kind}{c['id']}") for c in columns for kind, f in (("l", F.min), ("h", F.max))]
        found = {r[PART]: r for r in rows.groupBy(PART).agg(*ends).collect()}
        for p in parts:
            ranges = table["files"][p].setdefault("ranges", {})
            for c in columns:
                ends = (found[p][f"l{c['id']}"], found[p][f"h{c['id']}"]) if p in found else (None, None)
                if not any(isinstance(v, str) and len(v) > RANGE_TEXT or v != v for v in ends):
                    ranges[c["id"]] = list(ends)

    def _near(self, table: dict, parts: list[str], changed: DataFrame) -> tuple[int, int, Any]:
        """(number of changed rows, their highest ordinal, and, for some key columns, the parts that may hold their values)."""
        keys = [c for c in table["columns"] if (c["unique"] or c["name"] in table["primary_key"]) and c["type"] != "BOOL"]
        found = changed.agg(F.count(F.lit(1)).alias("n"), F.max(ROW_ID).alias("last"), *(f(c["id"]).alias(f"{kind}{c['id']}") for c in keys for kind, f in (("l", F.min), ("h", F.max)))).first()
        ends = {c["id"]: (found[f"l{c['id']}"], found[f"h{c['id']}"]) for c in keys}
        ends = {i: e for i, e in ends.items() if e[0] is not None and not any(v != v for v in e)}
        return found["n"], found["last"], lambda ids: self.catalog.holding(table, parts, {i: ends[i] for i in ids if i in ends}, table["columns"])

    def _bound(self, compiler: Compiler, name: str, where: Bounds, with_part: bool = True) -> tuple[DataFrame, Bound, DataFrame]:
        """(rows with physical names, row id and part; the binding; the physical rows beside the bound names)."""
        table = self.catalog.table(name)
        rows, columns = self.catalog.rows(table, with_part=with_part, where=where)
        number = f"s{next(compiler._numbers)}"
        bound = Bound(name, {c["name"]: (f"{number}_{c['id']}", SEEN[c["type"]]) for c in columns}, f"{number}_rid")
        beside = rows.select("*", *(F.col(c["id"]).alias(f"{number}_{c['id']}") for c in columns), F.col(ROW_ID).alias(f"{number}_rid"))
        return rows, bound, beside

    def _values(self, table: str, column: str) -> DataFrame:
        found = self.catalog.column(table, column)
        rows, _ = self.catalog.rows(self.catalog.table(table))
        return rows.select(F.col(found["id"]).alias("v"))

    def _converted(self, value, kind: str, column: dict, text: str):
        want = SEEN[column["type"]]
        if kind in (want, NULL) or {kind, want} <= {INT, FLOAT}:
            return value.cast(STORED[column["type"]])
        raise SemanticFault(text)

    # Inserts

    def put(self, s: S.Put) -> tuple[int, DataFrame]:
        table = self.catalog.table(s.table)
        names = [c["name"] for c in table["columns"]] if s.columns is None else list(s.columns)
        targets = [self.catalog.column(s.table, n) for n in names]
        if s.conflict:
            return self._upsert(s, table, targets)
        rows = self._from_query(s, targets) if s.query is not None else self._from_values(s, targets)
        rows = self._filled(s.table, table, rows, {t["id"] for t in targets})
        return self._insert(s.table, table, rows), rows

    def _from_values(self, s: S.Put, targets: list[dict]) -> DataFrame:
        made = []
        for i, row in enumerate(s.rows):
            if len(row) != len(targets):
                raise SemanticFault(f"INSERT has {len(row)} value(s) but {len(targets)} target column(s)")
            made.append((*(checked_literal(v.value, t) for v, t in zip(row, targets, strict=True)), i))
        return self.store.spark.createDataFrame(made, stored_schema(targets)).withColumnRenamed(ROW_ID, "nth").coalesce(1)

    def _from_query(self, s: S.Put, targets: list[dict]) -> DataFrame:
        found = self.compiler().fetch(s.query, None)
        if len(found.names) != len(targets):
            raise SemanticFault(f"INSERT has {len(found.names)} value(s) but {len(targets)} target column(s)")
        picked = [self._converted(F.col(f"c{i}"), k, t, f"type mismatch for column '{t['name']}': expected {t['type']}").alias(t["id"]) for i, (k, t) in enumerate(zip(found.types, targets, strict=True))]
        return self._numbered(found.frame.select(*picked))

    def _numbered(self, frame: DataFrame) -> DataFrame:
        """Rows with ``nth``, gapless from 0: places within partitions, and the partitions' sizes summed up."""
        rows = self.store.staged(frame.withColumn("at", F.monotonically_increasing_id()))
        sizes = sorted((r.p, r.n) for r in rows.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        before, starts = 0, []
        for p, n in sizes:
            starts.append((p, before))
            before += n
        first = self.store.spark.createDataFrame(starts, "p bigint, first bigint")
        return rows.join(F.broadcast(first), F.shiftright(F.col("at"), 33) == F.col("p")).withColumn("nth", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "p", "first")

    def _filled(self, name: str, table: dict, rows: DataFrame, given: set[str]) -> DataFrame:
        """Rows with all columns: automatic numbers, defaults, NULLs; staged."""
        out = []
        for c in table["columns"]:
            kind = STORED[c["type"]]
            if c["auto"]:
                number = F.lit(self._highest(table, c) + 1) + F.col("nth")
                out.append((F.coalesce(F.col(c["id"]), number) if c["id"] in given else number).cast(kind).alias(c["id"]))
            elif c["id"] in given:
                out.append(F.col(c["id"]))
            else:
                out.append(F.lit(c["default"]["value"] if c["default"] else None).cast(kind).alias(c["id"]))
        return self.store.staged(rows.select(*out, (F.lit(table["next_row"]) + F.col("nth")).cast("bigint").alias(ROW_ID)))

    def _highest(self, table: dict, column: dict) -> int:
        """The highest automatic number, or 0; read from rows only where a part has no range of it."""
        ranges = [table["files"][p].get("ranges", {}).get(column["id"]) for p in parts_of(table)]
        if None in ranges:
            return max(self.catalog.rows(table)[0].agg(F.coalesce(F.max(column["id"]), F.lit(0))).first()[0], 0)
        return max([0, *(high for _, high in ranges if high is not None)])

    def _insert(self, name: str, table: dict, rows: DataFrame) -> int:
        own, columns = parts_of(table), table["columns"]
        n, last, near = self._near(table, own, rows)
        if not n:
            return 0
        constraints.check_rows(name, table, rows)
        constraints.check_keys(name, table, rows, lambda ids: self.catalog.read(table, near(ids), columns))
        self._set_parts(name, [*self._packed(name, own), *self._write(name, rows)])
        constraints.check_references(table, rows, self._values)
        table["next_row"] = max(table["next_row"], last + 1)
        return n

    def _upsert(self, s: S.Put, table: dict, targets: list[dict]) -> tuple[int, DataFrame]:
        """Rows are taken in order: the first of a new key is inserted, and every other one changes the row that is there.

        A batch's values are literals, so keys are counted here; the changes see the existing row only, and are applied as
        often as the key comes up. A key with a NULL conflicts with nothing.
        """
        single = {c["name"] for c in table["columns"] if c["unique"]}
        keys = list(s.conflict.columns)
        if not (set(keys) <= single or set(keys) == set(table["primary_key"])):
            bad = next(k for k in keys if k not in single)
            raise SemanticFault(f"ON CONFLICT target '{bad}' must be UNIQUE or PRIMARY KEY")
        ids = [self.catalog.column(s.table, k)["id"] for k in keys]
        rows = self._filled(s.table, table, self._from_values(s, targets), {t["id"] for t in targets})
        batch = rows.orderBy(ROW_ID).collect()
        times = Counter(tuple(r[i] for i in ids) for r in batch)
        whole = [k for k in times if None not in k]
        spark = self.store.spark
        asked = spark.createDataFrame([(*k, times[k]) for k in whole], ", ".join([f"k{i} {STORED[self.catalog.column(s.table, n)['type']].simpleString()}" for i, n in enumerate(keys)] + ["times bigint"]))
        ends = {n: (min(v), max(v)) for n, *v in zip(keys, *whole, strict=True) if type(v[0]) is not bool} if whole else {}
        existing, _ = self.catalog.rows(table, with_part=True, where=ends)
        on = [F.col(i) == F.col(f"k{n}") for n, i in enumerate(ids)]
        hits = self.store.staged(existing.join(F.broadcast(asked), on, "inner").drop(*(f"k{n}" for n in range(len(ids)))))
        there = {tuple(r) for r in hits.select(*ids).collect()}
        fresh, seen = [], set()
        for r in batch:
            k = tuple(r[i] for i in ids)
            if None in k or (k not in there and k not in seen):
                fresh.append((*r, 0 if None in k else times[k] - 1))
                seen.add(k)
        schema = ", ".join([f"{c['id']} {STORED[c['type']].simpleString()}" for c in table["columns"]] + [f"{ROW_ID} bigint", "times bigint"])
        new = spark.createDataFrame(fresh, schema).coalesce(1)
        if s.conflict.changes is None:
            added = self.store.staged(new.drop("times"))
            return self._insert(s.table, table, added), added
        most = max(times.values(), default=0)
        plan = lambda frame: self._repeated(s, table, frame, most)
        added = self.store.staged(plan(new))
        changed = self.store.staged(plan(hits.drop(PART)).join(hits.select(ROW_ID, PART, *(F.col(c["id"]).alias(f"old_{c['id']}") for c in table["columns"])), ROW_ID))
        n = self._change(s.table, table, changed) + self._insert(s.table, table, added)
        return n, changed.select(*added.columns).unionByName(added)

    def _repeated(self, s: S.Put, table: dict, frame: DataFrame, most: int) -> DataFrame:
        """Rows with the changes applied ``times`` times."""
        for turn in range(most):
            compiler = self.compiler()
            number = f"s{next(compiler._numbers)}"
            bound = Bound(s.table, {c["name"]: (f"{number}_{c['id']}", SEEN[c["type"]]) for c in table["columns"]})
            beside = frame.select("*", *(F.col(c["id"]).alias(f"{number}_{c['id']}") for c in table["columns"]))
            new = self._assigned(compiler, s.table, s.conflict.changes, Scope([bound]))
            frame = beside.select(*((F.when(F.col("times") > turn, new[c["id"]]).otherwise(F.col(c["id"])) if c["id"] in new else F.col(c["id"])).alias(c["id"]) for c in table["columns"]), ROW_ID, "times")
        return frame.drop("times")

    # Changes and removals

    def _assigned(self, compiler: Compiler, name: str, changes: tuple, scope: Scope) -> dict[str, Any]:
        """Physical column to its new value; all see the old row."""
        new = {}
        for column, e in changes:
            c = self.catalog.column(name, column)
            value, kind = compiler.expression(e, scope)
            new[c["id"]] = self._converted(value, kind, c, f"type mismatch for column '{column}': expected {c['type']}")
        return new

    def modify(self, s: S.Modify) -> tuple[int, DataFrame]:
        table = self.catalog.table(s.table)
        compiler = self.compiler()
        _, bound, beside = self._bound(compiler, s.table, bounds(s.when, s.table, s.source is None))
        scope = Scope([bound])
        if s.source is not None:
            frame, other = compiler.bind(s.source, None)
            scope = Scope([bound, other])
            beside = beside.crossJoin(frame)  # the condition's equalities become join keys
        if s.when is not None:
            beside = beside.where(compiler.condition(s.when, scope))
        if s.source is not None:
            # Of several rows that match, the first counts.
            order = [F.col(other.row_id)] if other.row_id else [F.col(u) for u, _ in other.columns.values()]
            beside = beside.withColumn("nth", F.row_number().over(Window.partitionBy(ROW_ID).orderBy(*order))).where("nth = 1")
        new = self._assigned(compiler, s.table, s.changes, scope)
        delta = beside.select(*(new.get(c["id"], F.col(c["id"])).alias(c["id"]) for c in table["columns"]), ROW_ID, PART, *(F.col(c["id"]).alias(f"old_{c['id']}") for c in table["columns"]))
        delta = self.store.staged(delta)
        return self._change(s.table, table, delta), delta

    def remove(self, s: S.Remove) -> tuple[int, DataFrame]:
        table = self.catalog.table(s.table)
        compiler = self.compiler()
        _, bound, beside = self._bound(compiler, s.table, bounds(s.when, s.table, True))
        if s.when is not None:
            beside = beside.where(compiler.condition(s.when, Scope([bound])))
        delta = self.store.staged(beside.select(*(c["id"] for c in table["columns"]), ROW_ID, PART))
        return self._drop(s.table, table, delta), delta

    def _rest(self, table: dict, delta: DataFrame) -> tuple[list[str], DataFrame]:
        """(parts without a row of the delta, the other rows of the other parts)."""
        touched = {r[0] for r in delta.select(PART).distinct().collect()}
        rows = self.catalog.read(table, [p for p in parts_of(table) if p in touched], table["columns"])
        return [p for p in parts_of(table) if p not in touched], rows.join(delta.select(ROW_ID), ROW_ID, "left_anti")

    def _change(self, name: str, table: dict, delta: DataFrame) -> int:
        new = delta.select(*(c["id"] for c in table["columns"]), ROW_ID)
        kept, rest = self._rest(table, delta)
        n, _, near = self._near(table, kept, new)
        if not n:
            return 0
        constraints.check_rows(name, table, new)
        rest = rest.select(*new.columns)
        constraints.check_keys(name, table, new, lambda ids: self.catalog.read(table, near(ids), table["columns"]).unionByName(rest))
        self._set_parts(name, [*self._packed(name, kept), *self._write(name, rest.unionByName(new))])
        for child, column in self.catalog.children(name):
            key = self.catalog.column(name, column["reference"]["column"])["id"]
            pairs = delta.where(~F.col(f"old_{key}").eqNullSafe(F.col(key)) & F.col(f"old_{key}").isNotNull()).select(F.col(f"old_{key}").alias("v"), F.col(key).alias("to"))
            self._follow(child, column, pairs.dropDuplicates(["v"]), column["reference"]["on_modify"], name)
        constraints.check_references(table, new, self._values)
        return n

    def _drop(self, name: str, table: dict, delta: DataFrame) -> int:
        n = delta.count()
        if not n:
            return 0
        kept, rest = self._rest(table, delta)
        rest = rest.select(*(c["id"] for c in table["columns"]), ROW_ID)
        self._set_parts(name, kept if rest.isEmpty() else [*kept, *self._write(name, rest)])
        for child, column in self.catalog.children(name):
            key = self.catalog.column(name, column["reference"]["column"])["id"]
            gone = delta.select(F.col(key).alias("v")).dropna().distinct()
            gone = gone.join(self._values(name, column["reference"]["column"]), "v", "left_anti")  # unless another row still has it
            self._follow(child, column, gone.withColumn("to", F.lit(None).cast(STORED[column["type"]])), column["reference"]["on_remove"], name, removal=True)
        return n

    def _follow(self, child: str, column: dict, moved: DataFrame, action: str, parent: str, removal: bool = False) -> None:
        """A referential action on the rows of a child that refer to ``moved`` (v, to); recursive over their children."""
        table = self.catalog.table(child)
        rows, _ = self.catalog.rows(table, with_part=True)
        hit = rows.join(moved, F.col(column["id"]) == F.col("v"))
        if action == "RESTRICT":
            if not hit.isEmpty():
                raise RuntimeFault(f"foreign key violation: row is referenced by table '{child}'")
            return
        if removal and action == "CASCADE":
            self._drop(child, table, self.store.staged(hit.drop("v", "to")))
            return
        to = F.col("to") if action == "CASCADE" else F.lit(None).cast(STORED[column["type"]])
        delta = hit.select(*((to if c["id"] == column["id"] else F.col(c["id"])).alias(c["id"]) for c in table["columns"]), ROW_ID, PART, *(F.col(c["id"]).alias(f"old_{c['id']}") for c in table["columns"]))
        self._change(child, table, self.store.staged(delta))

    def truncate(self, name: str) -> int:
        table = self.catalog.table(name)
        if parts_of(table):
            self._set_parts(name, [])
            return 1
        return 0

    def fill(self, name: str, frame: DataFrame) -> int:
        """Rows of a query into a new table whose columns are in its order."""
        table = self.catalog.table(name)
        rows = self._numbered(frame.toDF(*(c["id"] for c in table["columns"])))
        rows = self._filled(name, table, rows, {c["id"] for c in table["columns"]})
        return self._insert(name, table, rows)


def returned(writer: Writer, name: str, delta: DataFrame, wanted: tuple) -> Relation:
    """The columns that RETURNING asks for, of all rows of a delta."""
    table = writer.catalog.table(name)
    columns = table["columns"] if not wanted else [writer.catalog.column(name, n) for n in wanted]
    return Relation(delta.orderBy(ROW_ID).select(*(F.col(c["id"]).alias(f"r{i}") for i, c in enumerate(columns))), [(c["name"], SEEN[c["type"]]) for c in columns])


