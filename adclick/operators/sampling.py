"""Splits and samples decided by a hash of the row's key.

The same rows are chosen whatever the partitioning, so both parts of a split
stay disjoint and complete when a task is retried. All are plain filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adclick.functions.hashing import unit_hash


def _row_unit(df: DataFrame, key: str, salt: str) -> Column:
    """The number of each row: of its key, or of the whole row where the key is
    null, so that rows without a key are sampled like others. Maps, which have
    no order, do not count."""
    whole = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.coalesce(unit_hash(F.col(key), salt), unit_hash(F.xxhash64(*whole), salt))


def hash_split(
    df: DataFrame, key: str, weights: Sequence[float] = (0.8, 0.2), seed: int = 36
) -> list[DataFrame]:
    """Disjoint, complete parts in the proportion of ``weights``. Rows with the
    same key stay together; rows with a null key are dealt by the whole row."""
    unit = _row_unit(df, key, f"split{seed}")
    total, parts, low = float(sum(weights)), [], 0.0
    for i, weight in enumerate(weights):
        high = low + weight / total
        inside = unit >= low if i == len(weights) - 1 else (unit >= low) & (unit < high)
        parts.append(df.filter(inside))
        low = high
    return parts


def stratified_sample(
    df: DataFrame, label: str, fractions: Mapping[float, float], key: str, seed: int = 36
) -> DataFrame:
    """Keep each class at its fraction; classes not named, and null, go."""
    unit = _row_unit(df, key, f"stratum{seed}")
    keep = F.lit(False)
    for value, fraction in fractions.items():
        chosen = F.lit(True) if fraction >= 1.0 else unit < fraction
        keep = F.when(F.col(label) == value, chosen).otherwise(keep)
    return df.filter(keep)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and negatives, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1.0).alias("positives"),
        F.count_if(F.col(label) == 0.0).alias("negatives"),
    )


def balancing_fraction(df: DataFrame, label: str = "label") -> float:
    """The share of negatives that makes both classes equally large."""
    counts = class_counts(df, label).first()
    return min(1.0, counts["positives"] / counts["negatives"]) if counts["negatives"] else 1.0


def downsample(df: DataFrame, fraction: float, key: str, seed: int = 36) -> DataFrame:
    """Keep this share of the rows, without replacement."""
    return df.filter(_row_unit(df, key, f"down{seed}") < fraction)


def balance(
    df: DataFrame,
    key: str,
    label: str = "label",
    fraction: float | str = 0.03,
    seed: int = 36,
) -> DataFrame:
    """All positives and a share of the negatives (``auto``: as many).

    One filter over one scan gives the rows of the union of both classes.
    """
    share = balancing_fraction(df, label) if fraction == "auto" else float(fraction)
    chosen = _row_unit(df, key, f"down{seed}") < share
    return df.filter((F.col(label) == 1.0) | ((F.col(label) == 0.0) & chosen))
