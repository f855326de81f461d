"""Constant arrays and maps as one expression each.

Building them from single literal Columns costs one call to the JVM per entry.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """SQL text of a string or a BIGINT."""
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{int(value)}L"


def constant_array(values) -> Column:
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def constant_map(entries: dict) -> Column:
    parts = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in entries.items())
    return F.expr(f"map({parts})")


def constant_structs(names, rows) -> Column:
    """An array of structs with fields ``names``."""
    def fields(row):
        return ", ".join(f"{sql_literal(n)}, {sql_literal(v)}" for n, v in zip(names, row, strict=True))

    return F.expr(f"array({', '.join(f'named_struct({fields(row)})' for row in rows)})")
