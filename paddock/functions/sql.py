"""Small helpers for writing Spark SQL expression text."""

from __future__ import annotations


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    """A backquoted column name."""
    return "`" + name.replace("`", "``") + "`"

