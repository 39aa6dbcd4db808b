"""Exact duplicates over all columns; missing equals missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, is_floating, known, pct
from tabscope.session import stage_table

HASHES = ("#h",)
#: Repeated hashes are told to every task up to so many, 8 bytes each.
TOLD_HASHES = 1_000_000


def nan_as_null(df: DataFrame) -> DataFrame:
    """One marker for missing values, so that equal rows group together."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[known(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once. Copies fold within a task before the shuffle,
    so a row repeated any number of times reaches its reducer a few times only."""
    return nan_as_null(df).distinct()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number and percentage of rows that repeat an earlier one.

    Rows are dealt out as 64-bit hashes, and only hashes that repeat are stored.
    Their rows are compared as they are, so rows that merely share a hash are told apart.
    """
    clean = nan_as_null(df)
    columns = [col(c) for c in clean.columns]
    hashed = clean.select("*", *(h.alias(c) for h, c in zip(row_hashes(columns), HASHES)))
    seen = Observation()
    counted = hashed.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("#n")).observe(seen, F.sum("#n").alias("n"))
    repeated = stage_table(counted.filter("`#n` > 1").select(*HASHES), "row-hashes")
    # No rows, no sum.
    n = seen.get["n"] or 0
    if repeated.limit(TOLD_HASHES + 1).count() <= TOLD_HASHES:
        repeated = F.broadcast(repeated)
    # Grouped by the hash too, so that rows which the join has dealt by it stay where they are.
    copies = hashed.join(repeated, list(HASHES), "left_semi").groupBy(*HASHES, *columns).agg(F.count(F.lit(1)).alias("#n"))
    extra = copies.agg(F.coalesce(F.sum(F.col("#n") - 1), F.lit(0)).cast("long").alias("extra"))
    return extra.select(
        F.col("extra").alias("duplicate_rows"), pct(F.col("extra"), F.lit(n).cast("long")).alias("duplicate_pct")
    )


def row_hashes(columns: list[Column]) -> list[Column]:
    """A 64-bit hash of a row as ``HASHES``; a NULL is told apart from what would hash like it."""
    known = [F.coalesce(F.xxhash64(c), F.lit(0)) for c in columns]
    gaps = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(*known, gaps)]
