"""Load a model version and score tables or feature maps, in batch or on a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numeric import col
from tabscope.operators.contract import check_features, expand_features
from tabscope.operators.preprocess import FittedPreprocessing
from tabscope.operators.scoring import predictions
from tabscope.plans.trainers import FEATURES, PROBABILITY, Scorer, load_scorer
from tabscope.plans.training import assembled
from tabscope.sources.registry import version_path
from tabscope.sources.tables import read_record


@dataclass(frozen=True)
class Bundle:
    """All that scoring needs: fitted preprocessing, a scorer and the model's metadata."""

    preprocessing: FittedPreprocessing
    scorer: Scorer
    metadata: dict
    root: str | None = None

    @property
    def feature_names(self) -> list[str]:
        return self.preprocessing.feature_names

    @property
    def classes(self) -> list[str]:
        return list(self.preprocessing.classes)

    def training_summary(self, spark: SparkSession) -> dict | None:
        """The summary written with the model; None where there is none."""
        if self.root is None:
            return None
        return read_record(spark, f"{self.root}/training_summary", optional=True)


def load_bundle(
    spark: SparkSession, models: str, version: str | None = None, preprocessing: str | None = None
) -> Bundle:
    """Load a version, the latest by default; any missing part fails the whole load."""
    root = version_path(spark, models, version)
    metadata = read_record(spark, f"{root}/metadata")
    fitted = FittedPreprocessing.load(
        spark, preprocessing or f"{models.rstrip('/')}/preprocessing"
    )
    return Bundle(fitted, load_scorer(spark, metadata["model_type"], f"{root}/model"), metadata, root)


def with_probabilities(df: DataFrame, bundle: Bundle, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns and the class probabilities of raw feature rows; a narrow plan throughout."""
    scaled = bundle.preprocessing.transform_features(df, keep)
    vectors = assembled(scaled, bundle.feature_names).select(*[col(c) for c in keep], FEATURES)
    return bundle.scorer.probabilities(vectors)


def score(df: DataFrame, bundle: Bundle, keep: tuple[str, ...] = ()) -> DataFrame:
    """One prediction per raw feature row."""
    return predictions(
        with_probabilities(df, bundle, keep),
        PROBABILITY,
        bundle.classes,
        bundle.metadata["version"],
        keep,
    )


def score_requests(
    requests: DataFrame, bundle: Bundle, features: str = "features", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Scored valid feature maps, and the rejected ones with the reason."""
    checked = check_features(requests, bundle.feature_names, features)
    rows = expand_features(checked.filter("valid"), bundle.feature_names, features, keep)
    rejected = checked.filter(~F.col("valid")).select(
        *[col(c) for c in keep], "missing_features", "unexpected_features", "detail"
    )
    return score(rows, bundle, keep), rejected


def model_info(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """One row: type, version, features, classes and test metrics of the loaded model."""
    meta = bundle.metadata
    row = (
        meta["model_type"],
        meta["version"],
        bundle.feature_names,
        bundle.classes,
        {k: float(v) for k, v in meta["metrics"].items()},
    )
    return spark.createDataFrame(
        [row],
        "model_type string, model_version string, feature_names array<string>, "
        "label_classes array<string>, metrics map<string,double>",
    )
