"""The full profile of a table, as small tables that the reports are made from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.classes import class_distribution
from tabscope.operators.column_stats import (
    CORRELATION,
    LOW_VARIANCE,
    constant_columns,
    infinite_values,
    low_variance_columns,
    missing_values,
    numeric_columns,
    profiled,
)
from tabscope.operators.correlation import coefficients, correlated_pairs, correlations
from tabscope.operators.duplicates import duplicate_rows
from tabscope.operators.scan import SCAN_COLUMNS, scan_table
from tabscope.operators.summary import STATISTICS, summary_statistics
from tabscope.session import stage_table


def settled(df: DataFrame) -> DataFrame:
    """Compute a result once: it is written to the shared folder, whatever its size."""
    return stage_table(df, "settled")


@dataclass(frozen=True)
class Profile:
    """What one look at a table found; each field holds one small table."""

    columns: DataFrame
    summary: DataFrame
    duplicates: DataFrame
    pairs: DataFrame
    correlated: DataFrame
    classes: DataFrame | None
    label: str | None
    n_rows: int
    n_cols: int
    size_bytes: int
    low_variance_threshold: float

    @property
    def missing(self) -> DataFrame:
        return missing_values(self.columns)

    @property
    def infinite(self) -> DataFrame:
        return infinite_values(self.columns)

    @property
    def constant(self) -> DataFrame:
        return constant_columns(self.columns)

    @property
    def low_variance(self) -> DataFrame:
        return low_variance_columns(self.columns, self.low_variance_threshold)


def build_profile(
    df: DataFrame,
    label: str = "Label",
    low_variance: float = LOW_VARIANCE,
    correlation: float = CORRELATION,
    approx: bool = False,
) -> Profile:
    """Profile ``df`` in four passes: one for the columns, their pairs and their values' leading
    bits, one each for the quartiles, duplicates and classes. The table is only read.

    More numeric columns than fit one pass have their quartiles' bits counted in passes of their own.
    """
    numeric = numeric_columns(df)
    shared = not approx and 0 < len(numeric) <= SCAN_COLUMNS
    scan = scan_table(df, with_pairs=len(numeric) > 1, with_keys=shared)
    columns = settled(profiled(scan.measures()))
    totals = columns.agg(F.max("n_rows"), F.count(F.lit(1)), F.sum("octets")).first()
    n_rows, n_cols, size = totals
    pairs = settled(coefficients(scan.pair_moments(), numeric) if len(numeric) > 1 else correlations(df))
    classes = class_distribution(df, label)
    return Profile(
        columns=columns,
        summary=settled(summary_statistics(df, profile=columns, approx=approx, cells=scan.cells)),
        duplicates=settled(duplicate_rows(df)),
        pairs=pairs,
        correlated=settled(correlated_pairs(pairs, correlation)),
        classes=None if classes is None else settled(classes),
        label=None if classes is None else label,
        n_rows=n_rows,
        n_cols=n_cols,
        size_bytes=size,
        low_variance_threshold=low_variance,
    )


def profile_record(profile: Profile) -> dict:
    """The profile as one nested record, bounded by columns, pairs and classes."""
    ordered = profile.columns.orderBy("ord")
    dup = profile.duplicates.first()
    record = {
        "n_rows": profile.n_rows,
        "n_cols": profile.n_cols,
        "memory_usage_bytes": profile.size_bytes,
        "column_dtypes": {r["column"]: r["dtype"] for r in ordered.collect()},
        "missing_values": {
            r["column"]: {"count": r["count"], "pct": r["pct"]}
            for r in profile.missing.orderBy("ord").collect()
        },
        "infinity_values": {
            r["column"]: r["count"] for r in profile.infinite.orderBy("ord").collect()
        },
        "duplicate_row_count": dup.duplicate_rows,
        "duplicate_row_pct": dup.duplicate_pct,
        "class_distribution": None,
        "summary_statistics": {
            r["column"]: {s: r[s] for s in STATISTICS}
            for r in profile.summary.orderBy("ord").collect()
        },
        "constant_columns": [r["column"] for r in profile.constant.orderBy("ord").collect()],
        "low_variance_columns": {
            r["column"]: r["variance"] for r in profile.low_variance.orderBy("ord").collect()
        },
        "highly_correlated_pairs": [
            {"feature_a": r.feature_a, "feature_b": r.feature_b, "correlation": r.correlation}
            for r in profile.correlated.orderBy(F.abs("correlation").desc(), "ord_a", "ord_b").collect()
        ],
        "label_column": profile.label,
    }
    if profile.classes is not None:
        record["class_distribution"] = {
            r.label: {"count": r["count"], "pct": r["pct"]}
            for r in profile.classes.orderBy(F.desc("count"), "label").collect()
        }
    return record


def profile_rows(profile: Profile) -> DataFrame:
    """The profile in long form: ``(section, subject, statistic, value)``."""
    spark = profile.columns.sparkSession
    shape = spark.createDataFrame(
        [
            ("table", "", "rows", float(profile.n_rows)),
            ("table", "", "columns", float(profile.n_cols)),
            ("table", "", "size_bytes", float(profile.size_bytes)),
        ],
        "section string, subject string, statistic string, value double",
    )

    def rows(df: DataFrame, section: str, subject, **values) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            subject.alias("subject"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(k).alias("statistic"), v.cast("double").alias("value")
                        )
                        for k, v in values.items()
                    ]
                )
            ),
        )

    c, name = F.col, F.col("column")
    parts = [
        rows(profile.missing, "missing", name, count=c("count"), pct=c("pct")),
        rows(profile.infinite, "infinite", name, count=c("count")),
        rows(
            profile.duplicates, "duplicates", F.lit(""), rows=c("duplicate_rows"), pct=c("duplicate_pct")
        ),
        rows(profile.constant, "constant", name, flag=F.lit(1)),
        rows(profile.low_variance, "low_variance", name, variance=c("variance")),
        rows(
            profile.correlated,
            "correlated",
            F.concat_ws(" <-> ", "feature_a", "feature_b"),
            r=c("correlation"),
        ),
        rows(profile.summary, "summary", name, **{s: c(f"`{s}`") for s in STATISTICS}),
    ]
    if profile.classes is not None:
        parts.append(rows(profile.classes, "classes", c("label"), count=c("count"), pct=c("pct")))
    out = shape
    for part in parts:
        out = out.union(part)
    return out
