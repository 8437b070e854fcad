"""Sinks: prediction CSV and feature-table export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _without_arrays(df: DataFrame) -> DataFrame:
    held = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.drop(*held)


def write_predictions(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrite ``path`` with header CSV and no success marker.

    CSV cannot hold arrays, so array columns are left out. ``single_file`` is
    for small exports: it shuffles the finished rows into one task instead of
    pulling the whole upstream stage there.
    """
    out = _without_arrays(df)
    if single_file:
        out = out.repartition(1)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        .csv(path)
    )


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep a feature table so that training need not repeat the cleaning."""
    if fmt == "csv":
        _without_arrays(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
