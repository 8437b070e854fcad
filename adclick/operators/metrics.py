"""Evaluation of predictions. Everything but the score-based area comes from
the confusion counts, which are one map-side-combined aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adclick.functions.features import ratio
from adclick.operators.ordering import ROWS_PER_TASK, running_totals
from adclick.sources.scratch import discard, materialise


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n); rows where either is null are left out."""
    return (
        df.select(
            F.col(label).cast("double").alias("label"),
            F.col(prediction).cast("double").alias("prediction"),
        )
        .filter("label is not null and prediction is not null")
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(
    df: DataFrame,
    classes: Sequence[float] = (0.0, 1.0),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Rows are the truth; one column ``predicted_<class>`` per class."""
    counts = [
        F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"predicted_{c:g}")
        for c in classes
    ]
    return confusion(df, label, prediction).groupBy("label").agg(*counts)


def class_statistics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: hits, rows of the class, rows predicted as the class."""
    n, hit = F.col("n"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    as_truth = F.struct(F.col("label").alias("class"), hit.alias("hits"), n.alias("actual"), zero.alias("predicted"))
    as_guess = F.struct(F.col("prediction").alias("class"), zero.alias("hits"), zero.alias("actual"), n.alias("predicted"))
    return (
        confusion(df, label, prediction)
        .select(F.explode(F.array(as_truth, as_guess)).alias("c"))
        .select("c.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "actual", "predicted")])
    )


def _share(part, whole):
    return F.coalesce(ratio(part.cast("double"), whole.cast("double")), F.lit(0.0))


def precision_recall(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision and recall of each class of the truth; 0 where undefined."""
    return class_statistics(df, label, prediction).filter("actual > 0").select(
        F.col("class").alias("label"),
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("actual")).alias("recall"),
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the share of right predictions, and one minus it."""
    right = F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0))
    return df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        right.alias("accuracy"), (1.0 - right).alias("test_error")
    )


def auc_hard(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: area under ROC of the 0/1 predictions, (1 + TPR - FPR) / 2;
    null where a class is absent or there are others than 0 and 1."""
    counts = confusion(df, label, prediction).agg(
        *[
            F.sum(F.when(F.expr(test), F.col("n")).otherwise(0)).cast("double").alias(name)
            for name, test in (
                ("tp", "label = 1 and prediction = 1"),
                ("p", "label = 1"),
                ("fp", "label = 0 and prediction = 1"),
                ("f", "label = 0"),
                ("others", "label not in (0, 1) or prediction not in (0, 1)"),
            )
        ]
    )
    tpr, fpr = ratio(F.col("tp"), F.col("p")), ratio(F.col("fp"), F.col("f"))
    return counts.select(F.when(F.col("others") == 0, (1.0 + tpr - fpr) / 2.0).alias("auc"))


def auc_score(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row: exact area under ROC of a score, ties counted half.

    Rows are counted per distinct score first; the running number of negatives
    over the scores then gives each score's share of ordered pairs.
    """
    scores = materialise(
        df.filter(F.col(score).isNotNull() & F.col(label).isin(0.0, 1.0))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1.0).alias("pos"), F.count_if(F.col(label) == 0.0).alias("neg")
        )
        .withColumn("all", F.lit(1)),
        "scores",
    )
    summed = running_totals(
        scores, "all", [F.col("score")], {"below": F.col("neg")}, scores.count(), rows_per_task
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = ratio(F.sum(pos * (F.col("below") - neg / 2.0)), F.sum(pos) * F.sum(neg))
    found = materialise(summed.agg(area.alias("auc")), "auc")
    discard(scores, summed)
    return found


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All hold-out metrics as (metric, label, value): accuracy, test_error,
    auc_hard (null unless the classes are 0 and 1), precision and recall of each
    class of the truth, and the confusion counts as ``predicted_<class>``."""
    hits, actual, predicted = (F.col(c).cast("double") for c in ("hits", "actual", "predicted"))
    binary = F.col("class").isin(0.0, 1.0)

    def item(metric, of, part, whole):
        return F.struct(
            F.lit(metric).alias("metric"), of.cast("double").alias("label"), part.alias("part"), whole.alias("whole")
        )

    every = F.lit(None)
    items = F.array(
        item("accuracy", every, hits, actual),
        item("test_error", every, actual - hits, actual),
        item("precision", F.col("class"), hits, predicted),
        item("recall", F.col("class"), hits, actual),
    )
    # any class besides 0 and 1, in truth or prediction, takes the count off two
    area = item(
        "auc_hard",
        every,
        F.when(binary & (actual > 0), hits / actual).otherwise(0.0),
        F.when(binary, (actual > 0).cast("double")).otherwise(3.0),
    )
    items = F.when(actual > 0, F.array_append(items, area)).otherwise(F.array(area))
    sums = (
        class_statistics(df, label, prediction)
        .select(F.explode(items).alias("i"))
        .select("i.*")
        .groupBy("metric", "label")
        .agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
    )
    halves = F.when(F.col("whole") == 2.0, F.col("part") / 2.0)
    value = F.when(F.col("metric") == "auc_hard", halves).otherwise(_share(F.col("part"), F.col("whole")))
    cells = confusion(df, label, prediction).select(
        F.concat(F.lit("predicted_"), F.format_string("%.0f", "prediction")).alias("metric"),
        "label",
        F.col("n").cast("double").alias("value"),
    )
    return sums.select("metric", "label", value.alias("value")).unionByName(cells)
