"""Interval joins: points in time that lie in intervals, by bins of equal keys.

An interval goes to the level whose bins are at least as long as it is (bins
double from level to level), so it touches two bins, however wide it is (up to
four on the last level).
A point goes to one bin of each level in use; there are at most ``LEVELS``. The
join is on (key, level, bin), then the bounds are compared. A bin that very many
points share is a join key like any other, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels there can be: lengths of 64-bit numbers.
LEVELS = 63


def _ticks(time: Column, kind: str) -> Column:
    """A time as a whole number: microseconds, days, or the number itself."""
    if kind == "timestamp":
        return F.unix_micros(time)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), time)
    if kind == "date":
        return F.unix_date(time).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return time.cast("long")
    raise TypeError(f"times of type {kind} are not whole; cast them to a timestamp, a date or a whole number")


def interval_join(
    points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, key: str | None = None, prefix: str = "interval_"
) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` for which ``start``
    <= ``time`` < ``end``, and of the same ``key`` if one is named. The columns of the
    interval get ``prefix``.

    Null times, bounds and keys meet nothing, nor do intervals that are empty or
    end before they start. Repeated rows are matched each.
    """
    clash = {f"{prefix}{c}".lower() for c in intervals.columns} & {c.lower() for c in points.columns}
    if clash:
        raise ValueError(f"result columns {sorted(clash)} are in both tables; choose another prefix")
    kinds = {c: dict(t.dtypes)[c] for t, c in ((points, time), (intervals, start), (intervals, end))}
    own = F.lit(0) if key is None else F.col(key)
    ranges = intervals.select(own.alias("key"), _ticks(F.col(start), kinds[start]).alias("a"), _ticks(F.col(end), kinds[end]).alias("b"), F.struct(*intervals.columns).alias("interval"))
    ranges = ranges.where("key is not null and a < b")
    # bins of 2 ** level ticks; in doubles, as a length may leave 64 bits
    length = F.col("b").cast("double") - F.col("a").cast("double")
    level = F.least(F.lit(LEVELS - 1), F.ceil(F.log2(length)).cast("int"))
    ranges = ranges.withColumn("level", level)
    ranges = ranges.withColumn("bin", F.explode(F.expr("sequence(shiftright(a, level), shiftright(b - 1, level))")))
    levels = sorted(r[0] for r in ranges.select("level").distinct().collect())
    moments = points.select(own.alias("key"), _ticks(F.col(time), kinds[time]).alias("t"), F.struct(*points.columns).alias("point"))
    moments = moments.where("key is not null and t is not null")
    listed = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    moments = moments.withColumn("level", F.explode(listed)).withColumn("bin", F.expr("shiftright(t, level)"))
    met = moments.join(ranges, ["key", "level", "bin"]).where("a <= t and t < b")
    return met.select(
        *[F.col("point").getField(c).alias(c) for c in points.columns],
        *[F.col("interval").getField(c).alias(f"{prefix}{c}") for c in intervals.columns],
    )
