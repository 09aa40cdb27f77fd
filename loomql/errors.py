"""What a statement can fail with. ``str()`` of each is the line a user sees."""


class EngineError(Exception):
    stage = "runtime error"

    def __str__(self) -> str:
        return f"ERROR  {self.stage}: {self.args[0]}"


class SyntaxFault(EngineError):
    def __init__(self, line: int, column: int, expected: str, near: str):
        super().__init__(f"expected {expected}")
        self.line, self.column, self.expected, self.near = line, column, expected, near

    def __str__(self) -> str:
        return f"ERROR  syntax error at line {self.line}, column {self.column}: expected {self.expected} (near '{self.near}')"


class SemanticFault(EngineError):
    stage = "semantic error"


class RuntimeFault(EngineError):
    """A constraint, a conflict between writers, or a failure while running."""
