"""Values that hold a large share of a table's rows, from one mergeable sketch.

The sketch keeps ``TRACKED`` counters. Tasks fill one each and theirs are merged;
a value above the share is never missed, and a few below it may be named. No row
is shuffled, and what reaches the driver is bounded by the share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counters of a sketch; it errs by some 1.4 / TRACKED of the rows.
TRACKED = 16_384


def heavy_hitters(df: DataFrame, value: Column, share: float) -> list[str]:
    """The values, as text, that hold at least ``share`` of the rows, with
    perhaps a few that hold little less. Null is not among them."""
    if not 2 / TRACKED < share <= 1:
        raise ValueError(f"share must be above {2 / TRACKED} and at most 1")
    top = F.call_function("approx_top_k", value.cast("string"), F.lit(int(2 / share)), F.lit(TRACKED))
    row = df.agg(top.alias("top"), F.count("*").alias("n")).first()
    return [entry["item"] for entry in row["top"] or [] if entry["item"] is not None and entry["count"] >= share * row["n"]]
