"""Relational operators as DataFrame operations."""
