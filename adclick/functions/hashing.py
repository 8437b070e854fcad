"""Reproducible pseudo-random numbers from a key.

A row's number depends only on its key and the salt, never on partitioning,
retries or row order, so splits and samples survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits: 52 bits, exact in a double.
_DIGITS = 13


def unit_hash(key: Column, salt: str) -> Column:
    """A double in [0, 1), uniform over distinct keys. Null keys give null."""
    digest = F.md5(F.concat(F.lit(salt + ":"), key.cast("string")))
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint")
    return number.cast("double") / F.lit(float(16**_DIGITS))
