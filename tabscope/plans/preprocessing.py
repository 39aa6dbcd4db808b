"""The preprocessing job: load, deduplicate, split, fit on train, transform, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.classes import split_class_distribution
from tabscope.operators.column_stats import LOW_VARIANCE
from tabscope.operators.duplicates import drop_duplicate_rows
from tabscope.operators.preprocess import FittedPreprocessing, fit
from tabscope.operators.split import SEED, SIZES, stratified_split
from tabscope.session import stage_table
from tabscope.sources.csv_tables import load_csv
from tabscope.sources.tables import write_record, write_splits


@dataclass(frozen=True)
class PreprocessingRun:
    summary: dict
    fitted: FittedPreprocessing
    paths: dict[str, str]


def preprocess_table(
    df: DataFrame,
    output: str,
    artifacts: str,
    *,
    label: str = "Label",
    key: str | None = None,
    sizes: tuple[float, float, float] = SIZES,
    seed: int = SEED,
    low_variance: float = LOW_VARIANCE,
    source: str = "",
) -> PreprocessingRun:
    """Run the job on a table. ``key`` is a unique column that is no feature.

    The distinct rows and the split table are written once each: everything
    after reads narrow columns of a stored table, and losing an executor
    costs the tasks it held, not the deduplication.
    """
    spark = df.sparkSession
    n_input = df.count()
    distinct = stage_table(drop_duplicate_rows(df), "distinct")
    placed = stage_table(
        stratified_split(distinct, label, sizes, seed, key), "placed", partition_by=["split"]
    )
    features = placed.drop(key) if key else placed
    train = features.filter(F.col("split") == "train").drop("split")
    fitted = fit(train, label, low_variance)
    kept = ("split", key) if key else ("split",)
    paths = {"processed": write_splits(fitted.transform(placed, kept), output)}
    paths |= {f"artifact_{k}": p for k, p in fitted.save(spark, artifacts).items()}

    per_split = {
        r.split: r.n
        for r in split_class_distribution(placed, label)
        .groupBy("split")
        .agg(F.sum("count").alias("n"))
        .collect()
    }
    n_distinct = sum(per_split.values())
    summary = {
        "source_path": source,
        "label_column": label,
        "n_rows_input": n_input,
        "n_rows_after_dedup": n_distinct,
        "n_duplicate_rows_removed": n_input - n_distinct,
        **{f"n_{s}_rows": per_split.get(s, 0) for s in ("train", "val", "test")},
        "train_size": sizes[0],
        "val_size": sizes[1],
        "test_size": sizes[2],
        "random_state": seed,
    }
    paths["run_summary"] = write_record(spark, summary, f"{artifacts}/run_summary")
    return PreprocessingRun(summary, fitted, paths)


def preprocess_csv(
    spark: SparkSession, path: str, output: str, artifacts: str, **options
) -> PreprocessingRun:
    """The same job from a CSV path."""
    return preprocess_table(load_csv(spark, path), output, artifacts, source=path, **options)
