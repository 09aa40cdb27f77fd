"""An interactive session: statements end with a semicolon; \\q quits, \\v shows the version, \\h helps."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from .engine import Engine
from .errors import EngineError
from .plans.lexer import split_statements, tokenize

HELP = "Statements end with ';'.  \\q quits, \\v shows the current version, \\h shows this."


def run(engine: Engine, lines: Iterable[str], show: Callable[[str], None] = print) -> None:
    waiting = ""
    for line in lines:
        word = line.strip()
        if not waiting and word.startswith("\\"):
            if word == "\\q":
                return
            show(f"version {engine.version}" if word == "\\v" else HELP if word == "\\h" else f"unknown command {word}")
            continue
        waiting += line if line.endswith("\n") else line + "\n"
        try:
            done = any(t.kind == "mark" and t.value == ";" for t in tokenize(waiting)[-2:])
        except EngineError as e:
            if waiting.count("'") % 2:  # a string goes on in the next line
                continue
            show(str(e))
            waiting = ""
            continue
        if done:
            for one in split_statements(waiting):
                try:
                    show(engine.execute(one).text())
                except EngineError as e:
                    show(str(e))
            waiting = ""


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    run(Engine(spark, sys.argv[1] if len(sys.argv) > 1 else "warehouse"), sys.stdin)


if __name__ == "__main__":
    main()
