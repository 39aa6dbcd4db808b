"""The describe table: count, mean, deviation, extremes and quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.column_stats import column_profile, numeric_columns, profiled
from tabscope.operators.quantiles import QUARTILES, approximate_quantiles, exact_quantiles
from tabscope.operators.scan import SCAN_COLUMNS, scan_table

# Fixed names and order of the statistics.
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def summary_statistics(
    df: DataFrame,
    columns: list[str] | None = None,
    *,
    profile: DataFrame | None = None,
    approx: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """One row per numeric column. Infinities are values, so their mean is infinite.

    ``profile`` and ``cells`` are what an earlier pass has found of the columns.
    """
    columns = numeric_columns(df) if columns is None else columns
    if profile is None and not approx and 0 < len(columns) <= SCAN_COLUMNS:
        # One pass for the moments and the leading bits of all columns.
        scan = scan_table(df, columns, with_keys=True)
        profile, cells = profiled(scan.measures()), scan.cells
        columns = [f.name for f in scan.fields]
    if profile is None:
        profile = column_profile(df, columns)
    if approx:
        long = approximate_quantiles(df, columns)
    else:
        long = exact_quantiles(df, columns, QUARTILES, cells=cells)
    quartiles = long.groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in zip(QUARTILES, ("25%", "50%", "75%"))
        ]
    )
    # Both sides hold one row per column.
    return (
        profile.filter("numeric")
        .select("ord", "column", F.col("n_known").alias("count"), "mean", "std", "min", "max")
        .join(F.broadcast(quartiles), "column")
        .select("ord", "column", *[f"`{s}`" for s in STATISTICS])
    )


def summary_wide(stats: DataFrame, columns: list[str]) -> DataFrame:
    """The same table turned: one row per statistic, one column per feature."""
    long = stats.select(
        "column",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ord"),
                        F.lit(s).alias("statistic"),
                        F.col(f"`{s}`").cast("double").alias("value"),
                    )
                    for i, s in enumerate(STATISTICS)
                ]
            )
        ),
    )
    return long.groupBy("ord", "statistic").pivot("column", columns).agg(F.first("value"))
