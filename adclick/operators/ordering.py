"""Running totals over a global order, without a single-task sort.

A window without partitions sorts all its rows in one task. Here the rows are
range-partitioned by the order, each range is summed on its own, and the sums
of the earlier ranges (one row per range) are added. Ranks are running counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adclick.sources.scratch import materialise

# Rows one task sorts comfortably: below it a plain window is used, above it
# it is the aimed size of a range.
ROWS_PER_TASK = 1_000_000


def running_totals(
    df: DataFrame,
    by: str,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    rows: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Append inclusive running sums of the bigint expressions in ``totals``.

    ``by`` names the column whose few values are summed apart, ``order`` must
    be total within it, and ``rows`` is the row count of ``df``, which decides
    between one window and the ranged form. Both give the same rows.
    """
    inclusive = (Window.unboundedPreceding, Window.currentRow)
    if rows <= rows_per_task:
        window = Window.partitionBy(by).orderBy(*order).rowsBetween(*inclusive)
        return df.select("*", *[F.sum(x).over(window).alias(n) for n, x in totals.items()])

    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = max(int(setting), -(-rows // rows_per_task))
    # Range bounds are sampled, so the range of each row is written down before
    # it is used twice.
    ranged = materialise(
        df.repartitionByRange(ranges, F.col(by), *order).withColumn(
            "__range", F.spark_partition_id()
        ),
        "ranges",
    )
    within = Window.partitionBy(by, "__range").orderBy(*order).rowsBetween(*inclusive)
    local = ranged.select("*", *[F.sum(x).over(within).alias(n) for n, x in totals.items()])
    # At most one row per range and value of ``by``: a bounded table.
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(by, "__range")
        .agg(*[F.sum(x).alias(f"__sum_{n}") for n, x in totals.items()])
        .select(
            F.col(by).alias("__by"),
            F.col("__range").alias("__of"),
            *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__sum_{n}") for n in totals],
        )
    )
    joined = local.join(
        F.broadcast(offsets), local[by].eqNullSafe(offsets["__by"]) & (local["__range"] == offsets["__of"])
    )
    result = joined.select(
        *df.columns, *[(F.col(n) + F.col(f"__sum_{n}")).alias(n) for n in totals]
    )
    result.scratch = ranged.scratch  # may be discarded once the result is written
    return result
