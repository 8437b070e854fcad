"""Stored sketches: distinct counts and quantiles by group, merged later.

A roll-up keeps, for each group (a day, say), the rows, a sketch of the distinct
values of some columns and one of the distribution of others. Sketches of any groups
merge into that of their union, so a later question reads the roll-up, a few kB
a group, and not the rows. Tasks combine before the shuffle, so a hot group is one
sketch a task.

A distinct count errs by ``1.04 / sqrt(2 ** log_k)`` (one standard deviation); a
rank by about ``2.3 / k ** 0.9`` of the rows. Nulls are in no sketch; NaN is in
none of quantiles. A group without values has a distinct count of 0 and null
quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 2 ** LOG_K registers: 1.6 % standard error.
LOG_K = 12
# Half a per cent of the rows.
K = 1024


def roll_up(
    df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (), log_k: int = LOG_K, k: int = K
) -> DataFrame:
    """(…by, rows, distinct_<c>, quantiles_<c>): one row a group, sketches as
    binary columns, to be written down."""
    counts = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(log_k)).alias(f"distinct_{c}") for c in distinct]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    spreads = [F.kll_sketch_agg_double(value(c), F.lit(k)).alias(f"quantiles_{c}") for c in quantiles]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *counts, *spreads)


def merge_rollups(rollup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The roll-up of coarser groups: the columns ``by``, or all rows as one."""
    sums = [F.sum("rows").alias("rows")]
    for name in rollup.columns:
        if name.startswith("distinct_"):
            sums.append(F.hll_union_agg(name).alias(name))
        elif name.startswith("quantiles_"):
            # a list of small sketches, one a group
            held = F.collect_list(name)
            merged = F.aggregate(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), F.get(held, 0), F.kll_sketch_merge_double)
            sums.append(merged.alias(name))
    return rollup.groupBy(*by).agg(*sums)


def read_rollup(rollup: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """The numbers of a roll-up: ``distinct_<c>`` as counts and ``quantiles_<c>``
    as arrays, one value for each share."""
    columns = []
    for name in rollup.columns:
        if name.startswith("distinct_"):
            columns.append(F.coalesce(F.hll_sketch_estimate(name), F.lit(0).cast("long")).alias(name))
        elif name.startswith("quantiles_"):
            some = F.kll_sketch_get_n_double(name) > 0
            values = [F.kll_sketch_get_quantile_double(name, F.lit(float(s))) for s in shares]
            columns.append(F.when(some, F.array(*values)).alias(name))
        else:
            columns.append(F.col(name))
    return rollup.select(*columns)
