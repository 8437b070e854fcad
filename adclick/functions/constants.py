"""Constant arrays written as SQL text: one call to the JVM instead of one per
value, which is most of the time it takes to build a wide plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_constant(value: str | int | float) -> str:
    """A SQL constant. ``$`` is written by its number, as ``${…}`` in SQL text
    would be taken for a variable."""
    if isinstance(value, str):
        for char, escaped in (("\\", "\\\\"), ("'", "\\'"), ("$", "\\u0024")):
            value = value.replace(char, escaped)
        return f"'{value}'"
    return f"{value!r}D" if isinstance(value, float) else f"{value}L"


def sql_array(values: Iterable[str | int | float]) -> str:
    return f"array({', '.join(map(sql_constant, values))})"


def constant_array(values: Iterable[str | int | float]) -> Column:
    return F.expr(sql_array(values))


# Entries of one bucket of a constant look-up, on average.
BUCKET = 4


def constant_lookup(keys: Sequence[str], values: Sequence[str | int | float]) -> Callable[[Column], Column]:
    """From one of ``keys`` to its value, null for other texts: the keys lie in
    buckets by checksum, so the cost does not grow with their number."""
    n = max(1, len(keys) // BUCKET)
    of: list[list[tuple]] = [[] for _ in range(n)]
    for key, value in zip(keys, values, strict=True):
        of[crc32(key.encode()) % n].append((key, value))
    kinds = {str: "string", int: "bigint", float: "double"}

    def column(side: int, kind: str) -> Column:
        inner = [sql_array([entry[side] for entry in own]) if own else f"cast(array() as array<{kind}>)" for own in of]
        return F.expr(f"array({', '.join(inner)})")

    known = column(0, "string")
    found = column(1, next((kinds[type(v)] for v in values), "string"))

    def find(text: Column) -> Column:
        bucket = (F.crc32(text) % n).cast("int")
        return F.get(F.get(found, bucket), F.array_position(F.get(known, bucket), text).cast("int") - 1)

    return find
