"""Small settings kept beside saved models, on any file system Spark knows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_json(spark: SparkSession, value, path: str) -> None:
    line = spark.createDataFrame([(json.dumps(value),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])
