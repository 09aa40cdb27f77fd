"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one operator with its own general interface;
``queries`` holds the thin ``opN_*`` entries that run the operators over whole tables.
"""
