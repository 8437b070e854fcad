"""Bid requests and a taxonomy derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.functions.interests import TOP_LEVEL, category_terms, taxonomy_rows
from adclick.sources.schema import BID_REQUEST, TAXONOMY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One bid request per event, with exactly the columns of the JSON input;
    ``events`` may be a stream of them.

    No join is hinted: nation and region are broadcast by their file size,
    customer too while it is small; beyond that the join is by shuffle and
    adaptive execution splits hot users.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    sizes = F.element_at(
        F.array(
            *[
                F.array(*[F.lit(x).cast("bigint") for x in wh]) if wh else F.lit(None).cast("array<bigint>")
                for wh in ((320, 50), (300, 250), (640, 360), (320, 480), (768, 1024), None)
            ]
        ),
        F.col("k") % 6 + 1,
    )
    systems = ("Android 9", "iOS 13", "WindowsPhone", "ANDROID", None, "BlackBerry", "ios")
    codes = F.concat(
        F.lit("IAB"), (1 + F.col("user_id") % 26).cast("string"),
        F.lit(",IAB"), (1 + F.col("k") % 26).cast("string"),
        F.lit("-1,"), F.col("c_mktsegment"),
    )
    interests = (
        F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 11 == 1, "Custom Segment").otherwise(codes)
    )
    start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    columns = {
        "appOrSite": F.when(F.col("k") % 2 == 0, "site").otherwise("app"),
        "bidfloor": F.col("value"),
        "city": F.when(F.col("user_id") % 3 != 0, F.col("n_name")),
        "exchange": F.col("n_name"),
        "impid": F.col("event_id").cast("string"),
        "interests": interests,
        "label": F.col("event_type") == "click",
        "media": F.col("c_mktsegment"),
        "network": F.col("r_name"),
        "os": F.element_at(F.array(*[F.lit(s) for s in systems]), F.col("k") % 7 + 1),
        "publisher": F.concat(F.lit("pub"), (F.col("k") % 40).cast("string")),
        "size": sizes,
        "timestamp": F.timestamp_diff("SECOND", start, F.col("ts")),
        "type": F.when(F.col("k") % 10 != 9, F.col("event_type")),
        "user": F.col("c_name"),
    }
    joined = (
        (table(spark, sf_dir, "events") if events is None else events)
        .withColumn("k", k)
        .join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in BID_REQUEST])


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public top level, nations as the first subcategories, and below them
    the names of parts and of their kinds: over 400 rows, as a full taxonomy has."""
    top = spark.createDataFrame(TOP_LEVEL, TAXONOMY)
    below = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("IAB"), (F.col("n_nationkey") + 1).cast("string"), F.lit("-1")).alias("Interest"),
        F.col("n_name").alias("Description"),
    )
    part = table(spark, sf_dir, "part")
    kinds = [F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.concat_ws(" ", "p_type", "p_size")]
    names = part.select(F.explode(F.array(*kinds)).alias("name")).distinct()
    parts = names.select(
        F.concat(F.lit("IAB"), (F.length("name") % 26 + 1).cast("string"), F.lit("-"), F.col("name")).alias("Interest"),
        F.col("name").alias("Description"),
    )
    return top.unionByName(below).unionByName(parts)


def terms(spark: SparkSession, sf_dir: str) -> dict[int, list[str]]:
    return category_terms(taxonomy_rows(taxonomy(spark, sf_dir)))
