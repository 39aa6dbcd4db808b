"""Pearson correlation of column pairs with pairwise deletion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numeric import finite_sql
from tabscope.operators.column_stats import CORRELATION, numeric_columns

HEATMAP_COLUMNS = 60
BLOCK_ROWS = 4096

#: What a task keeps of each pair over the rows where both values are present: their number,
#: both means, both sums of squared deviations and the sum of products of deviations.
MOMENTS = ("n", "mean_x", "mean_y", "dev_x", "dev_y", "dev_xy")
_STATE = ", ".join(f"{m} array<double>" for m in MOMENTS)


def _clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as v0, v1, ... with only finite values present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.selectExpr(*[f"{finite_sql(c, types[c])} AS v{i}" for i, c in enumerate(columns)])


def merged_moments(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together: deviations inside each, and of their means.

    Equal means differ by exactly zero, so a value that never changes keeps a
    spread of exactly zero over any number of merges.
    """
    n = left[0] + right[0]
    part = np.divide(right[0], n, out=np.zeros_like(n), where=n > 0)
    step_x, step_y = right[1] - left[1], right[2] - left[2]
    # A side without rows has no means to step from.
    one_sided = (left[0] == 0) | (right[0] == 0)
    weight = np.where(one_sided, 0.0, left[0] * part)
    move = np.where(left[0] == 0, 1.0, part)
    return np.array(
        [
            n,
            left[1] + np.where(right[0] == 0, 0.0, step_x * move),
            left[2] + np.where(right[0] == 0, 0.0, step_y * move),
            left[3] + right[3] + weight * step_x * step_x,
            left[4] + right[4] + weight * step_y * step_y,
            left[5] + right[5] + weight * step_x * step_y,
        ]
    )


def _full_block(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and products of deviations of columns without gaps.

    Values are taken relative to the first row, so a constant deviates by exactly zero.
    """
    d = z - z[0]
    mean = d.mean(axis=0)
    d -= mean
    return z[0] + mean, d.T @ d


def block_moments(z: np.ndarray) -> np.ndarray:
    """Moments of every pair a < b over one block of rows, in the order of ``triu_indices``."""
    rows, k = z.shape
    n, mean_x, mean_y, dev_x, dev_y, dev_xy = out = np.zeros((6, k, k))
    seen = np.isfinite(z)
    full = np.flatnonzero(seen.all(axis=0))
    if rows and len(full):
        mean, products = _full_block(z[:, full])
        at = np.ix_(full, full)
        spread = np.diag(products)
        n[at], mean_x[at], mean_y[at] = rows, mean[:, None], mean[None, :]
        dev_x[at], dev_y[at], dev_xy[at] = spread[:, None], spread[None, :], products
    for b in np.flatnonzero(~seen.all(axis=0)):
        mine = seen[:, b]
        if not mine.any():
            continue
        # Pairs of b: only rows that have b, and of those each partner's own.
        both, x, y = seen[mine], z[mine], z[mine, b]
        count = both.sum(axis=0)
        first = both.argmax(axis=0)
        parts = []
        for values in (x, np.broadcast_to(y[:, None], x.shape)):
            start = np.where(count > 0, values[first, np.arange(k)], 0.0)
            d = np.where(both, values - start, 0.0)
            step = np.divide(d.sum(axis=0), count, out=np.zeros(k), where=count > 0)
            parts.append((start + step, np.where(both, d - step, 0.0)))
        (mean_a, d_a), (mean_b, d_b) = parts
        column = (count, mean_a, mean_b, (d_a * d_a).sum(0), (d_b * d_b).sum(0), (d_a * d_b).sum(0))
        for m, values in zip(out, column, strict=True):
            m[:, b] = values
        # The same pairs seen from b's side.
        for m, values in zip(out, [column[i] for i in (0, 2, 1, 4, 3, 5)], strict=True):
            m[b, :] = values
    upper = np.triu_indices(k, 1)
    return out[:, upper[0], upper[1]]


def _task_moments(k: int):
    """One row per task with the moments of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k * (k - 1) // 2))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                total = merged_moments(total, block_moments(z.astype(np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array([m]) for m in total], names=list(MOMENTS))

    return run


def _merge_rows(k: int):
    """One row of moments from those of several tasks, read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k * (k - 1) // 2))
        for batch in batches:
            for i in range(batch.num_rows):
                row = np.array([c[i].values.to_numpy() for c in batch.columns])
                total = merged_moments(total, row)
        yield pa.RecordBatch.from_arrays([pa.array([m]) for m in total], names=list(MOMENTS))

    return run


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b`` and the moments of each pair of columns over its own rows.

    A task hands on one row whatever it has read. The rows of all tasks are
    merged in two steps: over the shuffle partitions, then in one task.
    """
    k = len(columns)
    sums = _clean(df, columns).mapInArrow(_task_moments(k), _STATE)
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in dict.fromkeys((groups, 1)):
        sums = sums.repartition(n).mapInArrow(_merge_rows(k), _STATE)
    upper = np.triu_indices(k, 1)
    ends = [F.split(F.lit(",".join(map(str, u))), ",").cast("array<int>") for u in upper]
    named = sums.select(ends[0].alias("a"), ends[1].alias("b"), *MOMENTS)
    return named.select(F.inline(F.arrays_zip("a", "b", *MOMENTS)))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ord_a, ord_b, feature_a, feature_b, r)`` of each pair, in column order.

    Infinities are missing here; a pair uses the rows where both values are
    present, and r is NULL where either does not vary over those rows.
    """
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "ord_a int, ord_b int, feature_a string, feature_b string, r double"
        )
    return coefficients(pair_moments(df, columns), columns)


def coefficients(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations from the moments of each pair."""
    r = F.try_divide("dev_xy", F.sqrt("dev_x") * F.sqrt("dev_y"))
    names = F.array(*[F.lit(c) for c in columns])
    return cells.select(
        F.col("a").alias("ord_a"),
        F.col("b").alias("ord_b"),
        F.get(names, F.col("a")).alias("feature_a"),
        F.get(names, F.col("b")).alias("feature_b"),
        # greatest() and least() pass over NULL, so an unknown r is set apart.
        F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"),
    )


def correlated_pairs(pairs: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """Pairs with |r| at the threshold or above, strongest first, ties in column order."""
    return (
        pairs.filter(F.abs("r") >= threshold)
        .select(
            "ord_a", "ord_b", "feature_a", "feature_b", F.round("r", 4).alias("correlation")
        )
        .orderBy(F.abs("correlation").desc(), "ord_a", "ord_b")
    )


def heatmap_columns(df: DataFrame, profile: DataFrame, limit: int = HEATMAP_COLUMNS) -> list[str]:
    """Every numeric column, or the ``limit`` of largest variance if there are more."""
    columns = numeric_columns(df)
    if len(columns) <= limit:
        return columns
    top = (
        profile.filter("numeric")
        .orderBy(F.col("fin_var").desc_nulls_last(), "ord")
        .limit(limit)
        .select("column")
    )
    return [r["column"] for r in top.collect()]


def correlation_matrix(pairs: DataFrame, profile: DataFrame, columns: list[str]) -> DataFrame:
    """The full matrix in long form: both triangles and the diagonal."""
    upper = pairs.select("feature_a", "feature_b", "r")
    lower = pairs.select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r"
    )
    diagonal = profile.filter(F.col("column").isin(columns)).select(
        F.col("column").alias("feature_a"),
        F.col("column").alias("feature_b"),
        F.when(F.col("fin_max") > F.col("fin_min"), F.lit(1.0)).alias("r"),
    )
    return upper.union(lower).union(diagonal)
