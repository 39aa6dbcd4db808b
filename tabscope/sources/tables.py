"""Reading and writing of split tables, reports and one-row JSON records."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def write_splits(df: DataFrame, path: str, as_csv: bool = False) -> str:
    """Write a table with a ``split`` column as one folder per part."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if as_csv:
        writer.csv(path, header=True)
    else:
        writer.parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All parts, or one of them; the filter prunes the other folders."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; use one of {list(SPLITS)}")
    return df.filter(F.col("split") == split).drop("split")


def write_csv(df: DataFrame, path: str) -> str:
    """A small report table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_text(spark: SparkSession, text: str, path: str) -> str:
    rows = spark.createDataFrame([(text,)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_record(spark: SparkSession, record: dict, path: str) -> str:
    """One JSON object; NaN is written as null."""
    return write_text(spark, json.dumps(nan_to_none(record)), path)


def nan_to_none(value):
    if isinstance(value, dict):
        return {k: nan_to_none(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [nan_to_none(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value


def read_record(spark: SparkSession, path: str, optional: bool = False) -> dict | None:
    """What ``write_record`` wrote; None for an absent optional record."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException:
        if optional:
            return None
        raise FileNotFoundError(f"no record at {path}") from None
    if not rows:
        if optional:
            return None
        raise FileNotFoundError(f"no record at {path}")
    return json.loads(rows[0].value)
