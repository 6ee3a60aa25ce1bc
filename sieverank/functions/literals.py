"""Tables of fixed values as one SQL literal each: a column for every value would be sent to the JVM one by one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql(value) -> str:
    """A string, number or sequence of them in SQL."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (tuple, list)):
        return f"array({', '.join(map(sql, value))})" if value else "cast(array() as array<string>)"
    return str(value)


def array(values: Iterable) -> Column:
    return F.expr(sql(tuple(values)))


def mapping(table: Mapping) -> Column:
    """A map of the entries, by key."""
    return F.expr(f"map({', '.join(f'{sql(k)}, {sql(v)}' for k, v in sorted(table.items()))})")


def structs(rows: Iterable[tuple], names: tuple[str, ...]) -> Column:
    """array<struct> of rows."""
    fields = (", ".join(f"{sql(n)}, {sql(v)}" for n, v in zip(names, row, strict=True)) for row in rows)
    return F.expr("array(" + ", ".join(f"named_struct({f})" for f in fields) + ")")
