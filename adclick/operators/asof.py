"""As-of joins: for each row the last row of another table at or before it.

Both tables become one, ordered by key and time, in which "the last one seen" is
a running window. The order is cut into ranges of rows, also within a key, so no
task grows with a hot key; rows of one key and time stay in one range. A key
that lies in several ranges has its last right row of each carried over to the
ranges after it. Such a key is the first or the last of a range, so what is
carried has at most two rows a range, however many ranges there are, and each
row finds its range by the shuffle, without a look at the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adclick.sources.scratch import discard, materialise

# Rows of one range, about; there are at least as many ranges as partitions.
RANGE_ROWS = 1_000_000
# Smaller ranges are asked of a table until there are so many a partition: each is
# a task and a file, which more of them do not make shorter.
RANGES_A_PARTITION = 4


def _ranges(rows: int, range_rows: int, partitions: int) -> int:
    """The number of ranges. It grows with the rows, so a range never has more
    than the larger of ``range_rows`` and ``RANGE_ROWS``, about."""
    wanted = -(-rows // range_rows)
    needed = -(-rows // max(range_rows, RANGE_ROWS))
    return max(partitions, needed, min(wanted, RANGES_A_PARTITION * partitions))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    ties: Sequence[str] = (),
    strict: bool = False,
    prefix: str = "last_",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has the same
    key and whose time is not after ``left_time`` (before it if ``strict``),
    named with ``prefix``; null where there is none.

    Of several rows at one time the greatest by ``ties``, then by ``columns``, is
    the last one. Times are numbers, dates or timestamps. Null keys and null
    times meet nothing; every left row comes out once, repeated rows included.
    """
    clash = {f"{prefix}{c}".lower() for c in columns} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"result columns {sorted(clash)} are in the left table; choose another prefix")
    # structs, so that no name of one table meets one of the other
    tied = [F.col(c).alias(f"t{i}") for i, c in enumerate(ties)]
    picked = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    lefts = left.select(F.col(key).alias("key"), F.col(left_time).alias("time"), F.struct(*left.columns).alias("left"))
    rights = right.select(F.col(key).alias("key"), F.col(right_time).alias("time"), F.struct(*tied, *picked).alias("last"))
    usable = F.col("key").isNotNull() & F.col("time").isNotNull()
    kind = {n: t.schema[n].dataType for t, n in ((lefts, "left"), (rights, "last"))}
    missing = lambda name: F.lit(None).cast(kind[name]).alias(name)
    # of one time the right rows come first, or last if they must be earlier
    first, second = (0, 1) if strict else (1, 0)
    both = lefts.where(usable).select("key", "time", F.lit(first).alias("side"), "left", missing("last")).unionAll(
        rights.where(usable).select("key", "time", F.lit(second).alias("side"), missing("left"), "last")
    )
    both = materialise(both, "asof")
    ranges = _ranges(both.count(), range_rows, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # bounds of ranges are sampled, so the range of each row is written down
    cut = both.repartitionByRange(ranges, "key", "time").withColumn("part", F.spark_partition_id())
    cut = materialise(cut, "ranges")
    discard(both)

    order = Window.partitionBy("key", "part").orderBy("time", "side", "last")
    seen = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = cut.withColumn("seen", seen).where("left is not null").select("key", "part", "left", "seen")
    # a key in several ranges is at the edge of each of them
    edges = cut.groupBy("part").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("keys")).select("part", F.explode("keys").alias("key"))
    edges = materialise(edges.withColumn("parts", F.count("*").over(Window.partitionBy("key"))).where("parts > 1").drop("parts"), "edges")
    ends = cut.where("last is not null").join(F.broadcast(edges), ["key", "part"], "left_semi")
    ends = ends.groupBy("key", "part").agg(F.max(F.struct("time", "last"))["last"].alias("end"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.join(ends, ["key", "part"], "left").select("key", "part", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    carried = materialise(carried, "carried")
    found = within.join(F.broadcast(carried), ["key", "part"], "left").select("left", F.coalesce("seen", "carried").alias("last"))
    apart = lefts.where(~usable).select("left", missing("last"))
    return found.unionAll(apart).select(
        *[_field("left", c).alias(c) for c in left.columns],
        *[_field("last", f"c{i}").alias(f"{prefix}{c}") for i, c in enumerate(columns)],
    )


def _field(struct: str, name: str) -> Column:
    return F.col(struct).getField(name)
