"""Spark SQL literals for generated expressions (``selectExpr``/``stack``)."""

from __future__ import annotations


def sql_string(v: str) -> str:
    """A Spark SQL string literal (backslash escapes, the parser default)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_literal(v) -> str:
    """Typed literal of a Python value; doubles go through a string so the
    value is exact."""
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    return sql_string(str(v))
