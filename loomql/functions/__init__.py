"""Column builders for the language's operators and scalar functions."""
