"""A bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, key: str, label: str, learn: Column, slots: int) -> DataFrame:
    """(id, label) of at most ``slots`` rows for each of the labels 0 and 1, the
    same on every run: the least hash of each slot. It is small enough to be
    broadcast. Ids labelled both ways, null ids and null labels are left out.
    """
    rows = labels.where(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    mixed = F.xxhash64("id")
    chosen = rows.groupBy("label", F.pmod(mixed, F.lit(slots)).alias("slot")).agg(
        F.min(F.struct(mixed.alias("h"), F.col("id"))).alias("m")
    )
    return chosen.select(F.col("m.id").alias("id"), F.col("label").cast("int").alias("label"))
