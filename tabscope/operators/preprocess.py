"""Column selection, imputation, scaling and label codes, fitted on training rows only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, finite_sql, quoted, sql_number
from tabscope.operators.classes import join_classes, label_codes
from tabscope.operators.column_stats import LOW_VARIANCE, chunked, column_profile, numeric_columns, profiled
from tabscope.operators.quantiles import exact_quantiles
from tabscope.operators.scan import SCAN_COLUMNS, scan_table
from tabscope.session import prefer_small_methods

PARAMETERS = "ord int, feature string, median double, mean double, scale double"
CLASSES = "code int, label string"
METADATA = (
    "label_column string, feature_columns array<string>, dropped_constant_columns array<string>, "
    "dropped_low_variance_columns array<string>, low_variance_threshold double, "
    "label_classes array<string>, label_mapping map<string,string>, n_train_rows bigint"
)


@dataclass(frozen=True)
class Feature:
    name: str
    median: float
    mean: float
    scale: float


@dataclass(frozen=True)
class FittedPreprocessing:
    """What a fit learnt: one entry per feature and per class, nothing per row."""

    label_column: str
    features: tuple[Feature, ...]
    classes: tuple[str, ...]
    dropped_constant: tuple[str, ...]
    dropped_low_variance: tuple[str, ...]
    low_variance_threshold: float
    n_train_rows: int

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]

    def parameters(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.name, f.median, f.mean, f.scale) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, PARAMETERS)

    def class_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.classes)), CLASSES)

    def metadata(self) -> dict:
        return {
            "label_column": self.label_column,
            "feature_columns": self.feature_names,
            "dropped_constant_columns": list(self.dropped_constant),
            "dropped_low_variance_columns": list(self.dropped_low_variance),
            "low_variance_threshold": self.low_variance_threshold,
            "label_classes": list(self.classes),
            "label_mapping": {str(i): c for i, c in enumerate(self.classes)},
            "n_train_rows": self.n_train_rows,
        }

    def scaled(self, df: DataFrame) -> list[Column]:
        """The feature columns in fitted order: finite value or median, then z-score."""
        missing = sorted(set(self.feature_names) - set(df.columns))
        if missing:
            raise ValueError(f"the table lacks fitted features: {missing}")
        prefer_small_methods(df.sparkSession)
        types = {f.name: f.dataType for f in df.schema.fields}
        return [
            F.expr(
                f"(coalesce({finite_sql(f.name, types[f.name])}, {sql_number(f.median)})"
                f" - {sql_number(f.mean)}) / {sql_number(f.scale)} AS {quoted(f.name)}"
            )
            for f in self.features
        ]

    def transform_features(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Scaled features; other columns go, except those in ``keep``. No label needed."""
        return df.select(*[col(c) for c in keep], *self.scaled(df))

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Scaled features and the class code under the label's name; a new class raises."""
        out = self.transform_features(df, (*keep, self.label_column))
        classes = self.class_table(df.sparkSession).toDF("#code", "#class")
        joined = join_classes(
            out,
            classes,
            len(self.classes),
            (col(self.label_column).cast("string"), "#class"),
            "left",
        )
        unseen = F.raise_error(
            F.concat(
                F.lit("label not seen in training: "),
                F.coalesce(col(self.label_column).cast("string"), F.lit("missing")),
            )
        ).cast("int")
        return joined.select(
            *[col(c) for c in keep],
            *[col(c) for c in self.feature_names],
            F.coalesce(F.col("#code"), unseen).alias(self.label_column),
        )

    def decode(self, df: DataFrame, code: str, name: str = "class") -> DataFrame:
        """Add the class name of an integer code; an unknown code raises."""
        classes = self.class_table(df.sparkSession).toDF("#code", "#class")
        joined = join_classes(
            df, classes, len(self.classes), (col(code), "#code"), "left"
        )
        unknown = F.raise_error(
            F.concat(F.lit("unknown class code: "), col(code).cast("string"))
        ).cast("string")
        return joined.select(
            *[col(c) for c in df.columns], F.coalesce(F.col("#class"), unknown).alias(name)
        )

    def save(self, spark: SparkSession, path: str) -> dict[str, str]:
        """Write parameters and classes as tables and the metadata as JSON."""
        paths = {n: f"{path}/{n}" for n in ("parameters", "classes", "metadata")}
        self.parameters(spark).coalesce(1).write.mode("overwrite").parquet(paths["parameters"])
        self.class_table(spark).coalesce(1).write.mode("overwrite").parquet(paths["classes"])
        text = spark.createDataFrame([(json.dumps(self.metadata()),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(paths["metadata"])
        return paths

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPreprocessing:
        """Read what ``save`` wrote; nothing is fitted again."""
        meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
        if meta is None:
            raise FileNotFoundError(f"no preprocessing metadata under {path}")
        # One row per column and per class: bounded by the width of the table.
        rows = spark.read.schema(PARAMETERS).parquet(f"{path}/parameters").orderBy("ord").collect()
        classes = spark.read.schema(CLASSES).parquet(f"{path}/classes").orderBy("code").collect()
        return FittedPreprocessing(
            label_column=meta.label_column,
            features=tuple(Feature(r.feature, r["median"], r["mean"], r["scale"]) for r in rows),
            classes=tuple(r.label for r in classes),
            dropped_constant=tuple(meta.dropped_constant_columns),
            dropped_low_variance=tuple(meta.dropped_low_variance_columns),
            low_variance_threshold=meta.low_variance_threshold,
            n_train_rows=meta.n_train_rows,
        )


@dataclass(frozen=True)
class FeatureSelection:
    kept: list[str]
    constant: list[str]
    low_variance: list[str]
    stats: dict[str, dict]


def select_features(
    train: DataFrame, label: str, low_variance: float = LOW_VARIANCE, profile: DataFrame | None = None
) -> FeatureSelection:
    """Numeric columns without the constant ones, then without those of low variance."""
    columns = numeric_columns(train, (label,))
    if not columns:
        raise ValueError("no features left: the table has no numeric column")
    profile = column_profile(train, columns) if profile is None else profile
    return selection({r["column"]: r.asDict() for r in profile.orderBy("ord").collect()}, columns, low_variance)


def selection(stats: dict[str, dict], columns: list[str], low_variance: float) -> FeatureSelection:
    constant = [c for c in columns if stats[c]["constant"]]
    candidates = [c for c in columns if c not in constant]
    low = [
        c
        for c in candidates
        if stats[c]["norm_var"] is not None and stats[c]["norm_var"] < low_variance
    ]
    kept = [c for c in candidates if c not in low]
    if not kept:
        raise ValueError("no features left: every numeric column is constant or hardly varies")
    return FeatureSelection(kept, constant, low, stats)


def _imputed_moments(stats: dict, median: float) -> tuple[float, float]:
    """Mean and population deviation once the missing values equal the median.

    The finite rows and the filled rows are two groups of known moments, so
    their union needs no further pass over the table.
    """
    n, known = stats["n_rows"], stats["n_finite"]
    filled, gap = n - known, median - stats["fin_mean"]
    squares = (stats["fin_var"] or 0.0) * (known - 1) + known * filled / n * gap * gap
    return stats["fin_mean"] + filled / n * gap, math.sqrt(squares / n)


def fit(
    train: DataFrame,
    label: str = "Label",
    low_variance: float = LOW_VARIANCE,
) -> FittedPreprocessing:
    """Learn everything from ``train``: one pass for the moments and the leading bits
    of all columns, one for the values near the medians, one over the label column."""
    columns = numeric_columns(train, (label,))
    if not columns:
        raise ValueError("no features left: the table has no numeric column")
    stats: dict[str, dict] = {}
    parts = chunked(columns, SCAN_COLUMNS)
    scans = [scan_table(train, part, with_keys=True) for part in parts]
    for scan in scans:
        stats |= {r["column"]: r.asDict() for r in profiled(scan.measures()).collect()}
    chosen = selection(stats, columns, low_variance)
    empty = [c for c in chosen.kept if not chosen.stats[c]["n_finite"]]
    if empty:
        raise ValueError(f"columns without any finite value have no median: {empty}")
    n_rows = chosen.stats[chosen.kept[0]]["n_rows"]
    medians = {
        r["column"]: r["value"]
        for part, scan in zip(parts, scans)
        for r in exact_quantiles(train, part, (0.5,), finite_only=True, cells=scan.cells).collect()
    }
    features = []
    for c in chosen.kept:
        mean, deviation = _imputed_moments(chosen.stats[c], medians[c])
        features.append(Feature(c, medians[c], mean, deviation or 1.0))
    classes = label_codes(train, label).orderBy("code").collect()
    return FittedPreprocessing(
        label_column=label,
        features=tuple(features),
        classes=tuple(r.label for r in classes),
        dropped_constant=tuple(chosen.constant),
        dropped_low_variance=tuple(chosen.low_variance),
        low_variance_threshold=low_variance,
        n_train_rows=n_rows,
    )
