"""Predictions from class probabilities, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.numeric import col
from tabscope.functions.probability import argmax, class_map, names_array, ranked


def predictions(
    df: DataFrame, probabilities: str, names: list[str], version: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Predicted class, its probability, the class map and the model version per row."""
    p = col(probabilities)
    return df.select(
        *[col(c) for c in keep],
        F.get(names_array(names), argmax(p)).alias("predicted_class"),
        F.array_max(p).alias("confidence"),
        class_map(names, p).alias("class_probabilities"),
        F.lit(version).alias("model_version"),
    )


def ranked_probabilities(
    df: DataFrame, probabilities: str, names: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per class with its rank, most likely first."""
    return df.select(*[col(c) for c in keep], F.inline(ranked(names, col(probabilities))))


def class_breakdown(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Predictions per class, within each value of ``by``."""
    return scored.groupBy(*[col(c) for c in by], "predicted_class").agg(
        F.count(F.lit(1)).alias("count")
    )


def top_n(df: DataFrame, group: str, value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``value`` per group; ties by ``tie``."""
    order = Window.partitionBy(col(group)).orderBy(col(value).desc(), col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
