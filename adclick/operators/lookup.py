"""Dimension lookups that hold for small and large dimensions and hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.functions.constants import constant_array, constant_lookup
from adclick.operators.heavy import heavy_hitters
from adclick.sources.scratch import materialise

# A dimension is broadcast up to this measured size.
BROADCAST_BYTES = 32 * 1024 * 1024
# A value holding this share of the rows is hot; there are at most 1 / share.
HOT_SHARE = 1 / 512
# Values looked up in the expression itself, without a join.
INLINE_VALUES = 64
# Elements looked up through a literal array in the plan.
LITERAL_ENTRIES = 1024


def inline_lookup(column: str, rows: Sequence[tuple[str | None, float]], default: float) -> Column:
    """The code of a column as an expression, for a handful of values."""
    known = [(value, code) for value, code in rows if value is not None]
    of_null = next((code for value, code in rows if value is None), default)
    found = F.lit(None).cast("double")
    if known:
        values, codes = (constant_array(side) for side in zip(*known, strict=True))
        found = F.get(codes, F.array_position(values, F.col(column).cast("string")).cast("int") - 1)
    coded = F.coalesce(found, F.lit(default))
    return F.when(F.col(column).isNull(), of_null).otherwise(coded)


def lookup(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    default: Column,
    size_bytes: int,
    total_rows: int,
    out: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace ``column`` (or fill ``out``) by its code in ``mapping``.

    ``mapping`` has one row per (value, code, n), ``n`` being the rows that held
    the value when it was built, ``total_rows`` of them in all, ``size_bytes``
    its measured size. Null is a value like any other; values not in the mapping
    get ``default``. A mapping too large to broadcast is joined by shuffle. The
    values hot in the mapping, those that a sketch finds hot in ``df``, seen before
    or not, and null are looked up beforehand in a broadcast of a few times
    1/HOT_SHARE rows, and the rows so answered are spread by a hash of the row.
    """
    out = out or column
    value = F.col(column).cast("string")
    if size_bytes <= broadcast_bytes:
        small = F.broadcast(mapping.select(F.col("value").alias("__v"), F.col("code").alias("__c")))
        joined = df.join(small, value.eqNullSafe(F.col("__v")), "left")
        return joined.withColumn(out, F.coalesce("__c", default)).drop("__v", "__c")

    found = heavy_hitters(df, value, HOT_SHARE)
    is_hot = (F.col("n") >= F.lit(max(2.0, HOT_SHARE * total_rows))) | F.col("value").isNull() | F.col("value").isin(found)
    # values that the mapping does not know are answered as well, by nothing
    named = df.sparkSession.createDataFrame([(v,) for v in (None, *found)], "__h string")
    known = mapping.filter(is_hot).select(F.col("value").alias("__v"), F.col("code").alias("__hot"))
    hot = named.join(known, F.col("__h").eqNullSafe(F.col("__v")), "full")
    hot = hot.select(F.coalesce("__h", "__v").alias("__h"), "__hot", F.lit(True).alias("__answered"))
    cold = mapping.filter(~F.coalesce(is_hot, F.lit(False))).select(
        F.col("value").alias("__v"), F.col("code").alias("__cold"), F.xxhash64("value").alias("__of")
    )
    answered = df.join(F.broadcast(hot), value.eqNullSafe(F.col("__h")), "left")
    # The second join key: of the value, but of the whole row where the value
    # is answered. A constant in its place would be folded out of the keys, and
    # a row number would not be the same again after a lost executor.
    spread = F.when(F.col("__answered"), F.xxhash64(*df.columns)).otherwise(F.xxhash64(value))
    keyed = answered.withColumn("__key", spread)
    joined = keyed.join(
        cold, value.eqNullSafe(F.col("__v")) & (F.col("__key") == F.col("__of")), "left"
    )
    coded = joined.withColumn(out, F.coalesce("__hot", "__cold", default))
    return coded.drop("__h", "__hot", "__answered", "__key", "__v", "__cold", "__of")


@dataclass(frozen=True)
class ElementMap:
    """A table (value, code, n), its rows where they are few, and its size."""

    table: DataFrame
    rows: list[tuple] | None
    size_bytes: int
    total_rows: int

    @classmethod
    def of(
        cls, table: DataFrame, literal_entries: int = LITERAL_ENTRIES, total_rows: int = 0
    ) -> ElementMap:
        """``n`` counts the rows a value was seen in, of ``total_rows``; a table
        without it has no values known to be hot. A value listed twice has its
        least code, however long the table is."""
        if "n" not in table.columns:
            table = table.withColumn("n", F.lit(0))
        table = table.groupBy("value").agg(F.min("code").alias("code"), F.sum("n").alias("n"))
        rows = table.select("value", "code").limit(literal_entries + 1).collect()
        if len(rows) <= literal_entries:
            return cls(table, [tuple(row) for row in rows], 0, total_rows)
        size = table.agg(F.sum(F.octet_length("value") + F.octet_length(F.col("code").cast("string")) + 64))
        return cls(table, None, size.first()[0], total_rows)

    def find(self, element: Column) -> Column:
        """The code of one element, null where there is none."""
        kind = self.table.schema["code"].dataType
        if not self.rows:
            return F.lit(None).cast(kind)
        known = [row for row in self.rows if None not in row]
        if not known:
            return F.lit(None).cast(kind)
        return constant_lookup(*zip(*known, strict=True))(element).cast(kind)


def lookup_elements(
    df: DataFrame,
    column: str,
    elements: ElementMap,
    otherwise: Callable[[Column], Column],
    out: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Fill ``out`` with the codes of an array's elements, in their order.

    ``otherwise`` maps an element that has no code. A short map goes into the
    plan as two constant arrays and stays in the projection. For a long one the
    rows are numbered and written down, as their own keys may be null or
    repeated; the exploded elements are looked up, as ``lookup`` does, and put
    together again by that number, so a group is never larger than one row's
    array. Null arrays stay null, empty ones empty.
    """
    if elements.rows is not None:
        return df.withColumn(
            out, F.transform(column, lambda e: F.coalesce(elements.find(e), otherwise(e)))
        )
    numbered = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    exploded = numbered.select("__row", F.posexplode(column).alias("__pos", "__element"))
    coded = lookup(
        exploded,
        "__element",
        elements.table,
        otherwise(F.col("__element")),
        elements.size_bytes,
        elements.total_rows,
        "__found",
        broadcast_bytes,
    )
    in_order = F.array_sort(F.collect_list(F.struct("__pos", "__found")))
    arrays = coded.groupBy("__row").agg(
        F.transform(in_order, lambda pair: pair["__found"]).alias("__codes")
    )
    empty = F.when(F.col(column).isNotNull(), F.array().cast(arrays.schema["__codes"].dataType))
    joined = numbered.join(arrays, "__row", "left")
    return joined.withColumn(out, F.coalesce("__codes", empty)).drop("__row", "__codes")
