"""Stratified train / validation / test split with exact class counts.

Within a class the rows are ordered by a seeded hash; the first ones form the
test part, the next the validation part, the rest trains. Sorting a class is
avoided: the hash at each cut is found by counting hash prefixes, and every
row is then placed by comparing its own hash with its class's two cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, is_missing
from tabscope.functions.ordering import row_text, seeded_hash
from tabscope.operators.classes import MIN_ROWS_PER_CLASS, class_counts, join_classes
from tabscope.session import stage_table

SIZES = (0.70, 0.15, 0.15)
SEED = 42
# Classes that an error text names; the error holds all.
SHOWN = 50
MISSING = "column {!r} has missing values; every row needs a class to be split"
# Hex digits told apart by the first and by the second counting round. The
# first keeps 256 counts per class, so that tasks fold nearly all their rows;
# the second meets one row in 128 and can afford more.
FIRST, SECOND = 2, 5


class RareClassesError(ValueError):
    """Classes have too few rows to appear in all three parts; ``classes`` holds all of them with their counts."""

    def __init__(self, classes: DataFrame, count: int, first: dict[str, int]):
        self.classes = classes
        more = f" and {count - len(first)} more, listed in .classes" if count > len(first) else ""
        super().__init__(
            f"a split into three parts needs {MIN_ROWS_PER_CLASS} rows of each class; too small: {first}{more}"
        )


def check_sizes(sizes: tuple[float, float, float]) -> None:
    total = sum(sizes)
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"train, validation and test sizes must sum to 1.0, got {total}")


def refuse_small(counts: DataFrame) -> None:
    """An error that names the classes of ``(label, count)`` that are too small."""
    small = stage_table(counts.filter(F.col("count") < MIN_ROWS_PER_CLASS), "rare-classes")
    count = small.count()
    if count:
        first = {r["label"]: r["count"] for r in small.orderBy("label").limit(SHOWN).collect()}
        raise RareClassesError(small, count, first)


def check_classes(df: DataFrame, label: str) -> None:
    """Raise if a row has no label or a class is too small; the message names them."""
    if not df.filter(is_missing(col(label), df.schema[label].dataType)).isEmpty():
        raise ValueError(MISSING.format(label))
    refuse_small(class_counts(df, label))


def _take(counts: DataFrame, size: str, drawn: Column, out: str) -> DataFrame:
    """Draw ``drawn`` rows in proportion to ``size``: whole parts, then largest remainders."""
    everywhere = Window.partitionBy()
    total = F.sum(size).over(everywhere)
    exact = F.col(size).cast("double") / total.cast("double") * drawn.cast("double")
    parts = (
        counts.withColumn("#drawn", drawn)
        .withColumn("#exact", exact)
        .withColumn("#whole", F.floor("#exact"))
        .withColumn("#rest", F.col("#exact") - F.col("#whole"))
    )
    rank = F.row_number().over(Window.orderBy(F.desc("#rest"), "label"))
    short = F.col("#drawn") - F.sum("#whole").over(everywhere)
    extra = F.when((rank <= short) & (F.col("#rest") > 0), 1).otherwise(0)
    return parts.withColumn(out, (F.col("#whole") + extra).cast("long")).drop(
        "#drawn", "#exact", "#whole", "#rest"
    )


def split_allocation(
    counts: DataFrame, sizes: tuple[float, float, float] = SIZES
) -> DataFrame:
    """Rows of each class in each part, from ``(label, count)``.

    The test part is cut first, the validation part from what is left; each
    overall size rounds up.
    """
    check_sizes(sizes)
    train, val, test = sizes
    everywhere = Window.partitionBy()
    total = F.sum("count").over(everywhere)
    left = _take(counts, "count", total - F.ceil(F.lit(test) * total), "#left")
    kept = F.sum("#left").over(everywhere)
    out = _take(left, "#left", kept - F.ceil(F.lit(val / (train + val)) * kept), "n_train")
    return out.select(
        "label",
        F.col("count").alias("n"),
        "n_train",
        (F.col("#left") - F.col("n_train")).alias("n_val"),
        (F.col("count") - F.col("#left")).alias("n_test"),
    )


def _within(counted: DataFrame, order: str) -> DataFrame:
    """The rows of ``(label, cut, seek, n)`` whose span of ranks holds the sought one."""
    upto = F.sum("n").over(Window.partitionBy("label", "cut").orderBy(order))
    return counted.withColumn("upto", upto).filter(
        (F.col("seek") <= F.col("upto")) & (F.col("seek") > F.col("upto") - F.col("n"))
    )


def _located(counted: DataFrame) -> DataFrame:
    """``(label, cut, prefix, seek)`` with the rank counted from the prefix's first hash."""
    return _within(counted, "prefix").select(
        "label", "cut", "prefix", (F.col("seek") - (F.col("upto") - F.col("n"))).alias("seek")
    )


def _inside(hashes: DataFrame, found: DataFrame, length: int, n_classes: int) -> DataFrame:
    """The hashes that begin like one of the cuts found so far."""
    begun = hashes.withColumn("prefix", F.substring("h", 1, length))
    return join_classes(begun, found, 2 * n_classes, ["label", "prefix"])


def first_counts(hashes: DataFrame) -> DataFrame:
    """Rows by class and two-digit prefix; a row without a label counts under NULL."""
    return hashes.groupBy("label", F.substring("h", 1, FIRST).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def split_cuts(hashes: DataFrame, first: DataFrame, allocation: DataFrame, n_classes: int) -> DataFrame:
    """``(label, test_cut, val_cut)``: the last hash of the test and validation parts.

    ``hashes`` is ``(label, h)`` and ``first`` counts their two-digit prefixes
    per class; the next round lengthens those that hold a cut. Only rows that
    share five digits with a cut are ranked, about a millionth of their class.
    """
    seeks = allocation.select(
        "label",
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("seek")),
                F.struct(F.lit("val").alias("cut"), (F.col("n_test") + F.col("n_val")).alias("seek")),
            )
        ),
    ).filter("seek > 0")
    number = F.count(F.lit(1)).alias("n")
    found = _located(join_classes(first, seeks, 2 * n_classes, "label"))
    second = _inside(hashes, found, FIRST, n_classes).groupBy(
        "label", "cut", "seek", F.substring("h", 1, SECOND).alias("prefix")
    )
    found = _located(second.agg(number))
    # Equal hashes count as one row here, and a cut among them would be inexact.
    tied = _inside(hashes, found, SECOND, n_classes).groupBy("label", "cut", "seek", "h").agg(number)
    exact = F.when(F.col("upto") == F.col("seek"), F.col("h")).otherwise(
        F.raise_error(F.lit("the split key is not unique within a class"))
    )
    cuts = _within(tied, "h").select("label", "cut", exact.alias("h"))
    return cuts.groupBy("label").agg(
        F.max(F.when(F.col("cut") == "test", F.col("h"))).alias("test_cut"),
        F.max(F.when(F.col("cut") == "val", F.col("h"))).alias("val_cut"),
    )


def stratified_split(
    df: DataFrame,
    label: str,
    sizes: tuple[float, float, float] = SIZES,
    seed: int = SEED,
    key: str | None = None,
    check: bool = True,
) -> DataFrame:
    """``df`` with a ``split`` column of 'train', 'val' or 'test'.

    ``key`` names a column that is unique within each class; without it the
    whole row is the key, which needs duplicates to be gone. The same seed and
    rows give the same split however the table is partitioned. Label and hash are
    stored once, and the counting rounds read only those.
    """
    check_sizes(sizes)
    if "split" in df.columns:
        raise ValueError("the table has a column named split already")
    text = F.when(~is_missing(col(label), df.schema[label].dataType), col(label).cast("string"))
    hashed = df.withColumn("#h", seeded_hash(seed, col(key) if key else row_text(df)))
    if key:
        hashes = stage_table(hashed.select(text.alias("label"), F.col("#h").alias("h")), "split-hashes")
    else:
        # Whole rows are read and hashed this once.
        hashed = stage_table(hashed, "split-rows")
        hashes = hashed.select(text.alias("label"), F.col("#h").alias("h"))
    # Sizes, missing labels and small classes follow from the first counts.
    first = stage_table(first_counts(hashes), "split-counts")
    counts = first.filter("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("count"))
    if check:
        if not first.filter("label IS NULL").isEmpty():
            raise ValueError(MISSING.format(label))
        refuse_small(counts)
    n_classes = counts.count()
    known = hashes.filter("label is not null")
    cuts = split_cuts(known, first.filter("label IS NOT NULL"), split_allocation(counts, sizes), n_classes).select(
        F.col("label").alias("#label"), "test_cut", "val_cut"
    )
    placed = join_classes(hashed, cuts, n_classes, (text, "#label"))
    part = (
        F.when(F.col("#h") <= F.coalesce("test_cut", F.lit("")), "test")
        .when(F.col("#h") <= F.coalesce("val_cut", F.lit("")), "val")
        .otherwise("train")
    )
    return placed.select(*[col(c) for c in df.columns], part.alias("split"))
