"""Rows set apart by a checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether the row is in the held-out part; a null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))
