"""Intermediate tables in the shared checkpoint folder.

Encoders and distributed ranking need a table that is computed once and then
read by several plans. It is written as parquet to the folder the cluster
names in ``spark.checkpoint.dir``, so a lost executor costs a re-read, never a
wrong answer, and the lineage ends there. Without that setting the folder lies
under the session's warehouse. Each application has a folder of its own, which
its file system removes when the application ends; ``discard`` removes a table
that is no longer read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder, the same way for a local session and a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def session_folder(spark: SparkSession) -> str:
    """The application's folder, made at first use and removed at its end."""
    folder = f"{checkpoint_root(spark)}/adclick/{spark.sparkContext.applicationId}"
    files, path = _file_system(spark, folder)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), schema: StructType | None = None
) -> DataFrame:
    """Write ``df`` once and return the written table, read by its own schema or
    by another one of the same stored types."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    written = spark.read.schema(schema or df.schema).parquet(path)
    written.scratch = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and no plan reads any more;
    other tables are left alone."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if isinstance(path, str):
            files, jvm_path = _file_system(table.sparkSession, path)
            files.delete(jvm_path, True)
