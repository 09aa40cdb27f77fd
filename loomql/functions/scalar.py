"""Column builders whose results are those of the language, not of Spark's defaults.

All of them are built-in JVM expressions, so they stay inside whole-stage code generation. Spark's ANSI mode is left as it
is found: what must give NULL uses the ``try_`` forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, FLOAT, BOOL, TEXT, TIME, NULL = "INT", "FLOAT", "BOOL", "TEXT", "TIME", "NULL"
#: White space that TRIM strips, as a character class.
_SPACE = r"[ \t\n\x0B\f\r]"
SPARK_TYPES = {INT: "bigint", FLOAT: "double", BOOL: "boolean", TEXT: "string", TIME: "timestamp_ntz", NULL: "void"}


def arithmetic(op: str, a: Column, b: Column, kind: str) -> Column:
    """Integers stay integers and divide toward zero; a division by zero, and a result beyond 64 bits, is NULL."""
    if op == "/":
        if kind == FLOAT:
            return F.try_divide(a.cast("double"), b.cast("double"))
        least = (a == F.lit(-(1 << 63)).cast("bigint")) & (b == F.lit(-1))  # its quotient is one too large
        return F.when(~F.coalesce(least, F.lit(False)), F.call_function("div", a, F.nullif(b, F.lit(0))))
    if kind == FLOAT:
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)


def like(value: Column, pattern: Column, literal: str | None) -> Column:
    """``%`` and ``_`` only: a backslash in a pattern is a backslash."""
    if literal is not None:
        return value.like(literal.replace("\\", "\\\\"))
    return F.like(value, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def to_text(value: Column, kind: str) -> Column:
    if kind == BOOL:
        return F.when(value, "TRUE").when(~value, "FALSE")
    return value.cast("string")


def cast(value: Column, kind: str, to: str) -> Column:
    """Casts never fail: what can't be read is NULL, and a text gives its longest numeric prefix."""
    none = F.lit(None).cast(SPARK_TYPES[to])
    if kind == NULL:
        return none
    if to == TEXT:
        return to_text(value, kind)
    if to == INT:
        if kind == BOOL:
            return value.cast("bigint")
        if kind == TEXT:
            return _try_cast(F.nullif(F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1), F.lit("")), "bigint")
        return _try_cast(value, "bigint") if kind in (INT, FLOAT) else none
    if to == FLOAT:
        if kind == TEXT:
            return _try_cast(F.nullif(F.regexp_extract(value, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")), "double")
        return value.cast("double") if kind in (INT, FLOAT) else none
    if to == BOOL:
        return value if kind == BOOL else value != 0 if kind == INT else none
    return none


def _try_cast(value: Column, to: str) -> Column:
    return value.try_cast(to)


def round_half_away(x: Column, digits: Column) -> Column:
    """Half away from zero in binary: the number is scaled, rounded and scaled back. One that is too large to have a
    fraction once it is scaled stays as it is; so do infinities."""
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    x = x.cast("double")
    scaled = F.abs(x) * scale
    return F.when(scaled >= F.lit(float(1 << 52)), x).otherwise(F.signum(x) * F.floor(scaled + F.lit(0.5)).cast("double") / scale)


def substr(s: Column, start: Column, length: Column | None) -> Column:
    """From a place counted from one; an earlier start is the first place and shortens nothing."""
    begin = F.when(start.isNotNull(), F.greatest(start, F.lit(1))).cast("int")
    rest = F.length(s)
    # greatest() passes over NULLs; a NULL length means all that is left.
    size = rest if length is None else F.when(length.isNull(), rest).otherwise(F.greatest(length, F.lit(0)).cast("int"))
    return F.substr(s, begin, size)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_SPACE}+|{_SPACE}+$", "")


def common_type(kinds: list[str]) -> str | None:
    """The type that values of these types have together, or None."""
    found = set(kinds) - {NULL}
    if not found:
        return NULL
    if len(found) == 1:
        return found.pop()
    if found <= {INT, FLOAT}:
        return FLOAT
    return TEXT if found <= {TEXT, TIME} else None


def as_type(value: Column, kind: str, to: str) -> Column:
    """A value of one type as one of a common type."""
    return value if kind == to else value.cast(SPARK_TYPES[to])


#: (fewest arguments, most arguments) of each function.
ARITY = {"UPPER": (1, 1), "LOWER": (1, 1), "LENGTH": (1, 1), "TRIM": (1, 1), "SUBSTR": (2, 3), "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 2), "MOD": (2, 2), "COALESCE": (1, None), "NULLIF": (2, 2)}


def call(name: str, arguments: list[tuple[Column, str]], fail: Callable[[str], None]) -> tuple[Column, str]:
    """(column, type) of a function; ``fail`` is given the text of a semantic error."""
    low, high = ARITY[name]
    if len(arguments) < low or (high is not None and len(arguments) > high):
        fail(f"{name} takes {low if high == low else f'{low} or {high}' if high else f'at least {low}'} argument(s)")
    columns, kinds = [a for a, _ in arguments], [k for _, k in arguments]

    def numeric(*places: int) -> None:
        if any(kinds[i] not in (INT, FLOAT, NULL) for i in places if i < len(kinds)):
            fail(f"{name} requires numeric arguments")

    if name in ("UPPER", "LOWER", "TRIM", "LENGTH"):
        text = to_text(columns[0], kinds[0]) if kinds[0] != NULL else F.lit(None).cast("string")
        made = {"UPPER": F.upper, "LOWER": F.lower, "TRIM": trim, "LENGTH": lambda c: F.octet_length(c).cast("bigint")}[name](text)
        return made, INT if name == "LENGTH" else TEXT
    if name == "SUBSTR":
        numeric(1, 2)
        return substr(to_text(columns[0], kinds[0]), columns[1].cast("bigint"), columns[2].cast("bigint") if len(columns) > 2 else None), TEXT
    if name == "ABS":
        numeric(0)
        return F.abs(columns[0]), kinds[0] if kinds[0] != NULL else INT
    if name in ("CEIL", "FLOOR"):
        numeric(0)
        return (F.ceil if name == "CEIL" else F.floor)(columns[0]).cast("bigint"), INT
    if name == "ROUND":
        numeric(0, 1)
        return round_half_away(columns[0], columns[1] if len(columns) > 1 else F.lit(0)), FLOAT
    if name == "MOD":
        if any(k not in (INT, NULL) for k in kinds):
            fail("MOD requires integer arguments")
        return F.try_mod(columns[0].cast("bigint"), columns[1].cast("bigint")), INT
    kind = common_type(kinds)
    if kind is None:
        fail(f"type mismatch in {name}")
    same = [as_type(c, k, kind) for c, k in arguments]
    return (F.coalesce(*same) if name == "COALESCE" else F.nullif(same[0], same[1])), kind if name == "COALESCE" else kinds[0]
