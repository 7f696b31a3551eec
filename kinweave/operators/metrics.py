"""Pair metrics and size histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: precision, recall, F1 and support of both classes, accuracy, macro and weighted means; 0 for empty ratios."""
    y, p = F.col(label), F.col(predicted)
    n = df.agg(*[F.count_if((y == i) & (p == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    for k, o in ((0, 1), (1, 0)):
        right = F.col(f"n{k}{k}")
        n = n.withColumns({f"precision_{k}": ratio(right, right + F.col(f"n{o}{k}")), f"recall_{k}": ratio(right, right + F.col(f"n{k}{o}")), f"support_{k}": right + F.col(f"n{k}{o}")})
        n = n.withColumn(f"f1_{k}", ratio(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}")))
    total = F.col("support_0") + F.col("support_1")
    means = {"accuracy": ratio(F.col("n00") + F.col("n11"), total)}
    for m in ("precision", "recall", "f1"):
        a, b = F.col(f"{m}_0"), F.col(f"{m}_1")
        means |= {f"macro_{m}": (a + b) / 2, f"weighted_{m}": ratio(a * F.col("support_0") + b * F.col("support_1"), total)}
    return n.withColumns(means).drop("n00", "n01", "n10", "n11")


def size_histogram(df: DataFrame, group: str) -> DataFrame:
    """(size, n): how many groups have each size, by size."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n")).orderBy("size")


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))
