"""From statement text to DataFrames: lexer, parser, and compiler."""
