"""Value encoders: fitted once as a mapping table, reused for every scoring.

All columns of an encoder are fitted in one scan: the columns are unpivoted to
(feature, value), counted (so each task sends every value once), and ranked.
The mapping is a table partitioned by feature; it never visits the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adclick.operators import lookup as L
from adclick.operators.ordering import ROWS_PER_TASK, running_totals
from adclick.sources.scratch import discard, materialise
from adclick.sources.settings import read_json, write_json

MAPPING = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("code", T.DoubleType()),
        T.StructField("feature", T.StringType()),
    ]
)


@dataclass(frozen=True)
class FeatureStats:
    """Measured facts of one fitted column."""

    values: int
    rows: int
    size_bytes: int
    default: float


@dataclass(frozen=True)
class ValueEncoder:
    """Mapping table (feature, value, n, code) and its measured sizes."""

    mapping: DataFrame
    stats: dict[str, FeatureStats]

    @property
    def columns(self) -> list[str]:
        return list(self.stats)

    def only(self, *columns: str) -> ValueEncoder:
        """The same encoder for some of its columns."""
        return ValueEncoder(self.mapping, {c: self.stats[c] for c in columns})

    def mapping_of(self, feature: str) -> DataFrame:
        """One column's part: a partition-pruned scan."""
        return self.mapping.filter(F.col("feature") == feature).select("value", "code", "n")

    @cached_property
    def _short(self) -> dict[str, list[tuple[str | None, float]]]:
        """The values of all columns that have only a handful, in one read."""
        short: dict[str, list] = {
            name: [] for name, stats in self.stats.items() if stats.values <= L.INLINE_VALUES
        }
        if short:
            for row in self.mapping.filter(F.col("feature").isin(list(short))).collect():
                short[row["feature"]].append((row["value"], row["code"]))
        return short

    def transform(
        self,
        df: DataFrame,
        columns: Sequence[str] | None = None,
        suffix: str = "",
        broadcast_bytes: int = L.BROADCAST_BYTES,
    ) -> DataFrame:
        """Encode the columns in place, or into ``<column><suffix>``.

        Short mappings become expressions, middling ones broadcast joins, large
        ones shuffle joins with hot values split off. ``broadcast_bytes=0``
        takes every column the last way.
        """
        inline = {}
        for column in columns or self.columns:
            stats = self.stats[column]
            if broadcast_bytes and column in self._short:
                inline[column + suffix] = L.inline_lookup(column, self._short[column], stats.default)
                continue
            df = L.lookup(
                df,
                column,
                self.mapping_of(column),
                F.lit(stats.default),
                stats.size_bytes,
                stats.rows,
                column + suffix,
                broadcast_bytes,
            )
        return df.withColumns(inline) if inline else df

    def save(self, path: str) -> None:
        spark = self.mapping.sparkSession
        self.mapping.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/mapping")
        write_json(spark, {name: asdict(stats) for name, stats in self.stats.items()}, f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ValueEncoder:
        raw = read_json(spark, f"{path}/stats")
        mapping = spark.read.schema(MAPPING).parquet(f"{path}/mapping")
        return cls(mapping, {name: FeatureStats(**stats) for name, stats in raw.items()})


def value_counts(
    df: DataFrame, columns: Sequence[str], arrays: Sequence[str] = ()
) -> DataFrame:
    """(feature, value, n) of the columns, and of the elements of the array
    columns, from one scan. Written down, as the ranking reads it repeatedly."""
    texts = [F.col(c).cast("string") for c in columns]
    if arrays:
        # The casts make all lists nullable alike: unpivot takes the first one's type.
        held = {c: F.array(text) for c, text in zip(columns, texts, strict=True)}
        held |= {name: F.col(name) for name in arrays}
        lists = df.select(*[x.cast("array<string>").alias(c) for c, x in held.items()]).unpivot([], [*columns, *arrays], "feature", "values")
        long = lists.select("feature", F.explode("values").alias("value"))
    else:
        named = [text.alias(c) for c, text in zip(columns, texts, strict=True)]
        long = df.select(*named).unpivot([], list(columns), "feature", "value")
    return materialise(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def _ranked(
    counts: DataFrame,
    columns: Sequence[str],
    order: Sequence[Column],
    first: int,
    unseen_after_last: bool,
    rows_per_task: int,
) -> ValueEncoder:
    # One row per column.
    sizes = {
        row["feature"]: row
        for row in counts.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("values"),
            F.sum("n").alias("rows"),
            F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64).alias("size_bytes"),
        )
        .collect()
    }
    total = sum(row["values"] for row in sizes.values())
    ranked = running_totals(
        counts, "feature", order, {"code": F.lit(1).cast("bigint")}, total, rows_per_task
    )
    mapping = ranked.select(
        "value", "n", (F.col("code") + (first - 1)).cast("double").alias("code"), "feature"
    )
    written = materialise(mapping, "mapping", ("feature",))
    discard(ranked)
    stats = {}
    for column in columns:
        row = sizes.get(column)
        values, rows, size = (row["values"], row["rows"], row["size_bytes"]) if row else (0, 0, 0)
        stats[column] = FeatureStats(values, rows, size, float(values) if unseen_after_last else 0.0)
    return ValueEncoder(written, stats)


def dictionary_of(
    counts: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> ValueEncoder:
    """The dictionary of columns whose values are counted already."""
    chosen = counts.filter(F.col("feature").isin(list(columns)))
    return _ranked(chosen, columns, [F.col("value").asc_nulls_first()], 1, False, rows_per_task)


def frequency_index_of(
    counts: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> ValueEncoder:
    """The frequency index of columns whose values are counted already."""
    chosen = counts.filter(F.col("feature").isin(list(columns)) & F.col("value").isNotNull())
    order = [F.col("n").desc(), F.col("value").asc()]
    return _ranked(chosen, columns, order, 0, True, rows_per_task)


def fit_dictionary(
    df: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> ValueEncoder:
    """Codes 1, 2, 3 … in value order. Null is a value and comes first; values
    not seen here are coded 0."""
    counts = value_counts(df, columns)
    encoder = dictionary_of(counts, columns, rows_per_task)
    discard(counts)
    return encoder


def fit_frequency_index(
    df: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> ValueEncoder:
    """Codes 0, 1, 2 … from the most frequent value down, ties in value order.
    Null and values not seen here share the code after the last."""
    counts = value_counts(df, columns)
    encoder = frequency_index_of(counts, columns, rows_per_task)
    discard(counts)
    return encoder
