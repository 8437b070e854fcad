"""One-way analysis of variance, for one value column or many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adclick.functions.features import ratio, square, squared_deviation
from adclick.operators.lookup import BROADCAST_BYTES, lookup
from adclick.sources.scratch import materialise


def with_group_mean(
    df: DataFrame,
    cat: str,
    value: str,
    out: str = "group_mean",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each row with the mean of its group; rows without a group drop out.

    The means are aggregated (so a very large group is not gathered in one
    task), measured, and looked up like any dimension.
    """
    grouped = df.filter(F.col(cat).isNotNull())
    means = materialise(
        grouped.groupBy(F.col(cat).cast("string").alias("value")).agg(
            F.avg(value).alias("code"), F.count(F.lit(1)).alias("n")
        ),
        "means",
    )
    size = means.agg(
        F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    ).first()
    missing = F.lit(None).cast("double")
    return lookup(grouped, cat, means, missing, size["bytes"], size["rows"], out, broadcast_bytes)


def group_statistics(df: DataFrame, cat: str, value: str) -> DataFrame:
    """Count, sum, mean, sum of squares and of squared deviations per group,
    from one aggregation. Rows with a null group or value are left out."""
    x = F.col(value).cast("double")
    return (
        df.filter(F.col(cat).isNotNull() & F.col(value).isNotNull())
        .groupBy(cat)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("total"),
            F.avg(x).alias("mean"),
            F.sum(square(x)).alias("total_squares"),
            (F.count(F.lit(1)) * F.var_pop(x)).alias("squared_deviations"),
        )
    )


def group_totals(groups: DataFrame) -> DataFrame:
    """One row over the result of ``group_statistics``."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("total_squares").alias("total_squares"),
        F.sum("squared_deviations").alias("squared_deviations"),
    )


def anova_screen(df: DataFrame, cat: str, values: Sequence[str]) -> DataFrame:
    """ANOVA of every value column against ``cat``, in one scan.

    One aggregation yields (n, mean, var_pop) of all columns per group; only
    its groups are unpivoted, not the rows. F, eta² and omega² are null where
    they are undefined (one group, one row per group, no variance at all).
    """
    measures = []
    for i, name in enumerate(values):
        x = F.col(name).cast("double")
        measures += [
            F.count(x).alias(f"__n{i}"), F.avg(x).alias(f"__m{i}"), F.var_pop(x).alias(f"__v{i}")
        ]
    wide = df.filter(F.col(cat).isNotNull()).groupBy(cat).agg(*measures)
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"__n{i}").alias("n"),
            F.col(f"__m{i}").alias("mean"),
            F.col(f"__v{i}").alias("variance"),
        )
        for i, name in enumerate(values)
    ]
    groups = wide.select(F.explode(F.array(*entries)).alias("g")).select("g.*").filter("n > 0")
    # One row per value column.
    centres = groups.groupBy(F.col("feature").alias("__feature")).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre")
    )
    sums = (
        groups.join(F.broadcast(centres), F.col("feature") == F.col("__feature"))
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * squared_deviation(F.col("mean"), F.col("centre"))).alias("ssb"),
            F.sum(F.col("n") * F.col("variance")).alias("ssw"),
        )
    )
    k, n, ssb, ssw = (F.col(c) for c in ("k", "n", "ssb", "ssw"))
    within = ratio(ssw, (n - k).cast("double"))
    return sums.select(
        "feature",
        (k - 1).alias("dfb"),
        (n - k).cast("double").alias("dfw"),
        ratio(ratio(ssb, (k - 1).cast("double")), within).alias("f_value"),
        ratio(ssb, ssb + ssw).alias("eta_sq"),
        ratio(ssb - (k - 1) * within, ssb + ssw + within).alias("omega_sq"),
    )


def anova(df: DataFrame, cat: str, value: str) -> DataFrame:
    """One row: dfb, dfw, f_value, eta_sq, omega_sq."""
    return anova_screen(df, cat, [value]).drop("feature")
