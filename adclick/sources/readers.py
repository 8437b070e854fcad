"""Scans: bid requests (JSON lines), taxonomy (CSV), feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adclick.sources.schema import BID_REQUEST, TAXONOMY


def read_requests(
    spark: SparkSession, path: str, strict: bool = False, corrupt: str | None = None, rest: str | None = None
) -> DataFrame:
    """JSON lines with the declared schema: one pass, none for inference.

    A line that cannot be read fails the job when ``strict``; with ``corrupt``
    its text is kept in a column of that name, which is null for good lines;
    otherwise it is left out, so that nothing without an id is scored.

    ``rest`` names a column for the fields that the schema does not: a JSON text
    of their names and their values as text, null where there are none. It
    stays on its row like any other column, in the export too.
    """
    if rest:
        return _with_rest(spark, path, strict, corrupt, rest)
    if strict:
        return spark.read.schema(BID_REQUEST).option("mode", "FAILFAST").json(path)
    name = corrupt or "_corrupt_record"
    schema = T.StructType([*BID_REQUEST.fields, T.StructField(name, T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", name).json(path)
    if corrupt:
        return rows
    # the test of a field keeps a count of the rows, which needs no other
    # column, from reading the corrupt column alone, as that is not allowed
    read = F.length(F.coalesce("impid", F.lit(""))) >= 0
    return rows.where(F.col(name).isNull() & read).drop(name)


def _with_rest(spark: SparkSession, path: str, strict: bool, corrupt: str | None, rest: str) -> DataFrame:
    """Lines taken apart twice: by the schema, and as a map of all fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    name = corrupt or "_corrupt_record"
    schema = T.StructType([*BID_REQUEST.fields, T.StructField(name, T.StringType())])
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": name}
    parsed = F.from_json("value", BID_REQUEST if strict else schema, options)
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    others = F.map_filter(fields, lambda k, _: ~k.isin([f.name for f in BID_REQUEST]))
    rows = lines.select(parsed.alias("row"), F.when(F.size(others) > 0, F.to_json(others)).alias("rest"))
    columns = [F.col("row").getField(f.name).alias(f.name) for f in BID_REQUEST]
    if strict:
        return rows.select(*columns, F.col("rest").alias(rest))
    if corrupt:
        return rows.select(*columns, F.col("row").getField(name).alias(corrupt), F.col("rest").alias(rest))
    return rows.where(F.col("row").getField(name).isNull()).select(*columns, F.col("rest").alias(rest))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of (Interest code, Description)."""
    return spark.read.schema(TAXONOMY).option("header", True).csv(path)


def read_features(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """A feature table written by ``sinks.write_features``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)
