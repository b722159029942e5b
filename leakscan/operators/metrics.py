"""Classification metrics. Everything after the first count runs on one row per pair of classes.

A null is a label of its own on either side, in every metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.operators.records import errors

# Fixed value: recall from which a class counts as recognised.
RECALL_LIMIT = 0.6


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(actual, predicted, n)`` of the pairs that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.col(actual).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] | None = None) -> DataFrame:
    """``(actual, predicted, n)`` for every pair of labels, zero cells included.

    Without ``labels`` the labels are all classes that occur on either side. With them, other classes are left out.
    """
    counts = pair_counts(df, actual, predicted)
    if labels is None:
        both = F.explode(F.array("actual", "predicted")).alias("label")
        held = F.collect_set(F.struct("label"))  # a struct keeps the null, which a set of labels would drop
        known = counts.select(both).agg(F.array_sort(F.transform(held, lambda s: s["label"])).alias("labels"))
    else:
        known = df.sparkSession.createDataFrame([(list(labels),)], "labels array<string>")
    grid = known.select("labels", F.explode("labels").alias("a")).select("a", F.explode("labels").alias("p"))
    same = F.col("a").eqNullSafe(F.col("actual")) & F.col("p").eqNullSafe(F.col("predicted"))
    return grid.join(counts, same, "left").select(
        F.col("a").alias("actual"), F.col("p").alias("predicted"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class on either side: true, predicted and correct counts, precision, recall, F1, recognised flag."""
    counts = pair_counts(df, actual, predicted)
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("t"), zero.alias("p"), hit.cast("long").alias("c")),
        F.struct(F.col("predicted").alias("class"), zero.alias("t"), F.col("n").alias("p"), zero.alias("c")),
    )
    totals = (
        counts.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum("s.t").alias("true_count"),
            F.sum("s.p").alias("predicted_count"),
            F.sum("s.c").alias("correct_count"),
        )
    )
    precision = _ratio(F.col("correct_count"), F.col("predicted_count"))
    recall = _ratio(F.col("correct_count"), F.col("true_count"))
    f1 = _ratio(2.0 * F.col("correct_count"), F.col("true_count") + F.col("predicted_count"))
    return totals.select(
        "*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (recall > RECALL_LIMIT).alias("recognised")
    )


def macro_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and unweighted means of precision, recall and F1 over all classes."""
    return per_class(df, actual, predicted).agg(
        (F.sum("correct_count") / F.sum("true_count")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class and for accuracy, macro and weighted averages."""
    classes = per_class(df, actual, predicted)
    support = F.sum("true_count")
    acc = F.sum("correct_count") / support
    weighted = lambda c: F.sum(F.col(c) * F.col("true_count")) / support
    row = lambda label, p, r, f: F.struct(
        F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.alias("support")
    )
    summary = classes.agg(
        F.array(
            row("accuracy", acc, acc, acc),
            row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return classes.select(
        F.col("class").alias("label"), "precision", "recall", "f1", F.col("true_count").alias("support")
    ).unionByName(summary)


def error_pairs(df: DataFrame, actual: str, predicted: str, k: int = 5) -> DataFrame:
    """The ``k`` most common confusions and their share of all errors."""
    counts = pair_counts(errors(df, actual, predicted), actual, predicted)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return (
        counts.withColumn("share", F.col("n") / total)
        .orderBy(F.desc("n"), "actual", "predicted")
        .limit(k)
    )
