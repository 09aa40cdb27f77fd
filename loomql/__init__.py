"""A Spark-native engine for a compact relational query language.

Statements are parsed and type-checked in Python and compiled to lazy DataFrames; Catalyst optimises and Spark executes.
"""

from .engine import Engine, Result
from .errors import EngineError, RuntimeFault, SemanticFault, SyntaxFault

__all__ = ["Engine", "EngineError", "Result", "RuntimeFault", "SemanticFault", "SyntaxFault"]
