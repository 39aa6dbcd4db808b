"""The prediction history: an append-only table and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.operators.scoring import top_n
from tabscope.sources.registry import list_folders

# Fixed sizes of the views.
LATEST = 200
TOP_CLASSES = 3

SCHEMA = (
    "id string, ts timestamp, kind string, model_version string, predicted_class string, "
    "confidence double, count bigint, class_breakdown map<string,bigint>"
)


def append_history(entries: DataFrame, path: str) -> None:
    """Entries go to a folder for each day, by its number since 1970."""
    names = T.StructType.fromDDL(SCHEMA).fieldNames()
    day = F.floor(F.unix_seconds("ts") / 86400).alias("day")
    entries.select(*names, day).write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, day bigint").parquet(path).drop("day")


def latest_history(spark: SparkSession, path: str, n: int = LATEST) -> DataFrame:
    """The newest ``n`` entries, from the last days that hold as many; older folders are not read."""
    days = [f.partition("=")[2] for f in list_folders(spark, path)]
    # Entries without a time stand in a folder that is no number, and come last.
    days.sort(key=lambda d: (d.lstrip("-").isdigit(), int(d) if d.lstrip("-").isdigit() else 0), reverse=True)
    root, take = path.rstrip("/"), 1
    while True:
        places = [f"{root}/day={d}" for d in days[:take]]
        if not places:
            return latest_entries(spark.createDataFrame([], SCHEMA), n)
        entries = spark.read.schema(SCHEMA).parquet(*places)
        if take >= len(days) or entries.limit(n).count() >= n:
            return latest_entries(entries, n)
        take *= 4


def latest_entries(history: DataFrame, n: int = LATEST) -> DataFrame:
    """Newest first; a top-k, so each task hands on at most ``n`` rows."""
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def single_entries(scored: DataFrame, id: str, ts: str) -> DataFrame:
    """One history entry per prediction: its class and confidence."""
    return scored.select(
        F.col(id).cast("string").alias("id"),
        F.col(ts).alias("ts"),
        F.lit("single").alias("kind"),
        "model_version",
        "predicted_class",
        "confidence",
        F.lit(1).cast("long").alias("count"),
        F.lit(None).cast("map<string,bigint>").alias("class_breakdown"),
    )


def batch_entries(scored: DataFrame, batch: str, ts: str) -> DataFrame:
    """One history entry per scored batch: its size and its class breakdown."""
    counts = scored.groupBy(batch, "model_version", "predicted_class").agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts")
    )
    return counts.groupBy(batch, "model_version").agg(
        F.max("ts").alias("ts"),
        F.sum("n").alias("count"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("predicted_class", "n")))
        ).alias("class_breakdown"),
    ).select(
        F.col(batch).cast("string").alias("id"),
        "ts",
        F.lit("batch").alias("kind"),
        "model_version",
        F.lit(None).cast("string").alias("predicted_class"),
        F.lit(None).cast("double").alias("confidence"),
        "count",
        "class_breakdown",
    )


def top_classes(history: DataFrame, n: int = TOP_CLASSES) -> DataFrame:
    """The most frequent classes of each batch entry."""
    cells = history.filter(F.col("kind") == "batch").select(
        "id", F.explode("class_breakdown").alias("predicted_class", "n")
    )
    return top_n(cells, "id", "n", "predicted_class", n)
