"""Class counts, imbalance, weights and label codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, is_missing, pct
from tabscope.session import stage_table

# Name under which rows without a label are counted.
MISSING_CLASS = "nan"
MIN_ROWS_PER_CLASS = 3

# A class table is broadcast up to this many rows; beyond it a class of more than KEY_ROWS rows is salted.
BROADCAST_CLASSES = 100_000
KEY_ROWS = 500_000


def _label(df: DataFrame, label: str) -> tuple[Column, Column]:
    dtype = df.schema[label].dataType
    missing = is_missing(col(label), dtype)
    return F.when(~missing, col(label).cast("string")), missing


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, missing labels left out."""
    text, missing = _label(df, label)
    return df.filter(~missing).groupBy(text.alias("label")).count()


def class_distribution(df: DataFrame, label: str) -> DataFrame | None:
    """Count and percentage per class, most frequent first; None without the column.

    Rows without a label form a class of their own.
    """
    if label not in df.columns:
        return None
    text, _ = _label(df, label)
    counts = df.groupBy(F.coalesce(text, F.lit(MISSING_CLASS)).alias("label")).count()
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", pct(F.col("count"), total).alias("pct")).orderBy(
        F.desc("count"), "label"
    )


def class_imbalance(distribution: DataFrame) -> DataFrame:
    """Majority and minority class and how many times larger the one is.

    Ties go to the first class name for the majority, the last for the minority.
    """
    ranked = distribution.select(
        "label",
        "count",
        F.struct((-F.col("count")).alias("n"), F.col("label").alias("l")).alias("rank"),
    )
    cell = F.struct("label", "count")
    out = ranked.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min_by(cell, "rank").alias("most"),
        F.max_by(cell, "rank").alias("least"),
    )
    return out.select(
        "n_classes",
        F.col("most.label").alias("majority"),
        F.col("most.count").alias("majority_count"),
        F.col("least.label").alias("minority"),
        F.col("least.count").alias("minority_count"),
        F.coalesce(
            F.try_divide(F.col("most.count").cast("double"), F.col("least.count").cast("double")),
            F.lit(float("inf")),
        ).alias("ratio"),
    ).filter("n_classes > 0")


def rare_classes(df: DataFrame, label: str, minimum: int = MIN_ROWS_PER_CLASS) -> DataFrame:
    """Classes too small for a three-way split."""
    return class_counts(df, label).filter(F.col("count") < minimum)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)``: classes in text order, numbered from 0."""
    codes = F.row_number().over(Window.orderBy("label")) - 1
    return class_counts(df, label).select("label", codes.cast("int").alias("code"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight N / (k * n) of each class of n rows, for k classes and N rows."""
    counts = class_counts(df, label)
    everywhere = Window.partitionBy()
    return counts.select(
        "label",
        F.col("count").alias("n"),
        (
            F.sum("count").over(everywhere)
            / (F.count(F.lit(1)).over(everywhere) * F.col("count"))
        ).cast("double").alias("weight"),
    )


def join_classes(df: DataFrame, classes: DataFrame, n_classes: int, on: str | list[str] | tuple[Column, str], how: str = "inner") -> DataFrame:
    """Attach a class table of known size to rows, by shared columns or by (expression of the rows, class column).

    Broadcast when small. For a larger table the rows are dealt by class. A class
    of more than ``KEY_ROWS`` rows gets salts by its counted size, under which its
    one entry is repeated; other classes are left as they are.
    """
    pair = isinstance(on, tuple)
    names = [on] if isinstance(on, str) else on
    if n_classes <= BROADCAST_CLASSES:
        condition = on[0] == F.col(on[1]) if pair else names
        return df.join(F.broadcast(classes), condition, how)
    left, right = ([on[0]], [col(on[1])]) if pair else ([col(k) for k in names], [col(k) for k in names])
    keyed = df.withColumns({f"#k{i}": k for i, k in enumerate(left)})
    keys = [f"#k{i}" for i in range(len(left))]
    salts = F.ceil(F.col("#rows") / KEY_ROWS).alias("#salts")
    # At most one row for each KEY_ROWS rows.
    heavy = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("#rows")).filter(F.col("#rows") > KEY_ROWS).select(*keys, salts)
    heavy = F.broadcast(stage_table(heavy, "heavy-classes"))
    many = F.coalesce("#salts", F.lit(1))
    dealt = keyed.join(heavy, keys, "left").withColumn("#salt", F.pmod(F.monotonically_increasing_id(), many)).drop("#salts")
    repeated = classes.withColumns({k: c for k, c in zip(keys, right)}).join(heavy, keys, "left")
    repeated = repeated.withColumn("#salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("#salts")
    if not pair:
        repeated = repeated.drop(*names)
    return dealt.join(repeated, [*keys, "#salt"], how).drop("#salt", *keys)


def split_class_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(col(split).alias("split"), col(label).alias("label")).count()


def ordered_labels(mapping: DataFrame) -> DataFrame:
    """Class names by their code taken as a number, so 10 follows 9."""
    return mapping.select(F.col("code").cast("int").alias("code"), "label").orderBy("code")
