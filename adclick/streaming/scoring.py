"""Requests and clicks as streams: repeats dropped, requests scored, late clicks
joined to what was shown.

State is bounded by event time: a key is remembered, and a row waits for its
partner, as long as the watermark allows, so rows later than the delay may count
twice or find no partner. Times are event times of type timestamp; rows without
one, or without a key, are left out. A finite stream that is no later than its
delay gives what the same work gives on a table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adclick.operators.lookup import BROADCAST_BYTES
from adclick.plans import jobs, models
from adclick.sources.schema import FeatureSpec
from adclick.sources.scratch import scratch_path


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files: int | None = None) -> DataFrame:
    """Files as they arrive, at most ``files`` of them in one batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(fmt).load(path)


def first_of_each(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row of each key within the delay; later repeats are dropped."""
    known = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return known.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def joined_within(
    shown: DataFrame, clicks: DataFrame, key: str, shown_time: str, click_time: str, within: str, delay: str | None = "1 hour", outer: bool = False
) -> DataFrame:
    """Each shown row with the clicks of the same key that follow it by at most
    ``within``, in whatever order they arrive. The columns of the click get
    ``click_``. ``outer`` also gives shown rows without a click, once the
    watermark tells that none can come. Streams that have a watermark already,
    as those without repeats have, take no ``delay`` here."""
    renamed = clicks.select(*[F.col(c).alias(f"click_{c}") for c in clicks.columns])
    at = f"click_{click_time}"
    left = shown.where(F.col(key).isNotNull() & F.col(shown_time).isNotNull())
    right = renamed.where(F.col(f"click_{key}").isNotNull() & F.col(at).isNotNull())
    if delay is not None:
        left, right = left.withWatermark(shown_time, delay), right.withWatermark(at, delay)
    in_time = (F.col(key) == F.col(f"click_{key}")) & (F.col(at) >= F.col(shown_time)) & (F.col(at) <= F.col(shown_time) + F.expr(f"interval {within}"))
    return left.join(right, in_time, "left_outer" if outer else "inner")


def scored(
    requests: DataFrame, features: jobs.FeatureModel, model: PipelineModel | models.ForestModel, spec: FeatureSpec, delay: str = "1 hour"
) -> DataFrame:
    """Predictions for a stream of requests, each ``impid`` once. Scoring is one
    narrow stage; dictionaries must be small enough to be broadcast."""
    large = [c for c, s in features.encoder.stats.items() if s.size_bytes > BROADCAST_BYTES]
    if large or isinstance(features.terms, DataFrame):
        raise ValueError(f"dictionaries {large} or a table of terms are too large for a stream")
    timed = requests.withColumn("__time", F.timestamp_seconds("timestamp"))
    return jobs.predict_with(features, model, spec, first_of_each(timed, "impid", "__time", delay).drop("__time"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Work off all that has arrived and return the written result. State and
    progress lie in the shared scratch folder, so a lost executor costs a retry."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    query.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
