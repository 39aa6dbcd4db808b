"""Train every candidate, compare on validation, keep and test the best."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numeric import col
from tabscope.functions.probability import argmax
from tabscope.operators.classes import balanced_weights, join_classes
from tabscope.operators.contract import require_columns
from tabscope.operators.evaluation import (
    SCALARS,
    classification_report,
    confusion_matrix,
    evaluate,
    pair_counts,
)
from tabscope.operators.preprocess import FittedPreprocessing
from tabscope.plans.trainers import (
    FEATURES,
    LABEL,
    PROBABILITY,
    WEIGHT,
    Scorer,
    TreeScorer,
    available_trainers,
)
from tabscope.sources.registry import claim_version, complete_version
from tabscope.sources.tables import read_split, write_record
from tabscope.session import stage_table

SELECTION_METRIC = "f1_macro"
N_TREES = 200
SEED = 42


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the feature vector; every value is known after preprocessing."""
    # The assembler reads dots as nesting, so it gets plain stand-in names.
    plain = df.select("*", *[col(f).alias(f"#f{i}") for i, f in enumerate(features)])
    vector = VectorAssembler(
        inputCols=[f"#f{i}" for i in range(len(features))], outputCol=FEATURES
    ).transform(plain)
    return vector.drop(*[f"#f{i}" for i in range(len(features))])


def training_rows(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """``(features, label, weight)`` with class-balanced weights."""
    weights = balanced_weights(train, label).select(
        F.col("label").cast("int").alias("#code"), F.col("weight").alias(WEIGHT)
    )
    rows = assembled(train, features).select(
        FEATURES, col(label).cast("int").alias("#y"), col(label).cast("double").alias(LABEL)
    )
    n_classes = train.select(col(label)).distinct().count()
    joined = join_classes(rows, weights, n_classes, (F.col("#y"), "#code"))
    return joined.select(FEATURES, LABEL, WEIGHT)


def predicted(df: DataFrame, features: list[str], label: str, scorer: Scorer) -> DataFrame:
    """``(y, yp, probabilities)`` of labelled rows."""
    scored = scorer.probabilities(assembled(df, features).select(FEATURES, col(label).alias("y")))
    return scored.select("y", argmax(F.col(PROBABILITY)).alias("yp"), PROBABILITY)


def evaluation_record(scored: DataFrame, codes: list[int], names: list[str]) -> dict:
    """All metrics as one nested record, of a size fixed by the number of classes.

    The scored rows are written first: the model then runs once, not once per metric.
    """
    scored = stage_table(scored, "scored")
    counts = pair_counts(scored)
    record = evaluate(scored, codes, probabilities=PROBABILITY).first().asDict()
    cells = {(r.y_true, r.y_pred): r.n for r in confusion_matrix(counts, codes).collect()}
    record["confusion_matrix"] = [[cells[a, b] for b in codes] for a in codes]
    record["classification_report"] = {
        r["class"]: (
            r["precision"]
            if r["class"] == "accuracy"
            else {
                "precision": r["precision"],
                "recall": r["recall"],
                "f1-score": r["f1_score"],
                "support": float(r["support"]),
            }
        )
        for r in classification_report(counts, codes, names).orderBy("ord").collect()
    }
    return record


@dataclass(frozen=True)
class TrainingRun:
    version: str
    summary: dict
    best: TreeScorer
    paths: dict[str, str]


def best_model(metrics: dict[str, dict], metric: str) -> str:
    """Model type with the highest metric; the first trained on a tie."""
    if metric not in SCALARS:
        raise ValueError(f"unknown selection metric {metric!r}; use one of {list(SCALARS)}")
    return max(metrics, key=lambda m: metrics[m][metric])


def class_counts_by_split(df: DataFrame, label: str, names: list[str]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {s: {} for s in ("train", "val", "test")}
    rows = df.groupBy("split", col(label).alias("code")).count().orderBy(F.desc("count"), "code")
    for r in rows.collect():
        out[r.split][names[r.code]] = r["count"]
    return out


def train_candidates(
    spark: SparkSession,
    processed: str,
    preprocessing: str,
    models: str,
    *,
    metric: str = SELECTION_METRIC,
    n_trees: int = N_TREES,
    seed: int = SEED,
    only: tuple[str, ...] | None = None,
) -> TrainingRun:
    """Fit each candidate on the train part and write a new model version.

    ``processed`` and ``preprocessing`` are what the preprocessing job wrote;
    the fitted parameters are read, never fitted again. The test part is
    scored once, by the winner alone.
    """
    fitted = FittedPreprocessing.load(spark, preprocessing)
    features, label, names = fitted.feature_names, fitted.label_column, list(fitted.classes)
    codes = list(range(len(names)))
    table = spark.read.parquet(processed)
    require_columns(table, features, f"processed data at {processed}")

    # Written once, so that each of the many passes of a fit reads ready vectors.
    rows = stage_table(training_rows(read_split(spark, processed, "train"), features, label), "rows")
    val = read_split(spark, processed, "val")

    trainers, skipped = available_trainers()
    if only is not None:
        trainers = {k: t for k, t in trainers.items() if k in only}
    scorers: dict[str, TreeScorer] = {}
    val_metrics: dict[str, dict] = {}
    for name, trainer in trainers.items():
        scorers[name] = trainer(n_trees=n_trees, seed=seed).fit(rows)
        val_metrics[name] = evaluation_record(
            predicted(val, features, label, scorers[name]), codes, names
        )
    winner = best_model(val_metrics, metric)
    test_metrics = evaluation_record(
        predicted(read_split(spark, processed, "test"), features, label, scorers[winner]),
        codes,
        names,
    )

    version = claim_version(spark, models)
    root = f"{models.rstrip('/')}/{version}"
    by_split = class_counts_by_split(table, label, names)
    short = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")
    metadata = {
        "model_type": winner,
        "version": version,
        "feature_names": features,
        "metrics": {
            m: test_metrics[m]
            for m in (*short, "roc_auc_ovr_macro")
            if test_metrics[m] is not None
        },
    }
    summary = {
        "version": version,
        "best_model_type": winner,
        "selection_metric": metric,
        "trained_models": list(scorers),
        "skipped_models": skipped,
        "val_metrics": val_metrics,
        "test_metrics": test_metrics,
        "feature_importances": {
            m: dict(zip(features, s.importances())) for m, s in scorers.items()
        },
        "class_distribution": by_split,
        "n_train_rows": sum(by_split["train"].values()),
        "n_val_rows": sum(by_split["val"].values()),
        "n_test_rows": sum(by_split["test"].values()),
        "feature_columns": features,
        "label_mapping": {str(i): n for i, n in enumerate(names)},
        "random_state": seed,
    }
    paths = {n: f"{root}/{n}" for n in ("model", "metadata", "training_summary")}
    scorers[winner].save(spark, paths["model"])
    write_record(spark, summary, paths["training_summary"])
    write_record(spark, metadata, paths["metadata"])
    complete_version(spark, models, version)
    return TrainingRun(version, summary, scorers[winner], paths)


def importance_rows(spark: SparkSession, summary: dict) -> DataFrame:
    """``(model, ord, feature, importance)`` of a training summary."""
    rows = [
        (model, i, feature, float(value))
        for model, values in summary["feature_importances"].items()
        for i, (feature, value) in enumerate(values.items())
    ]
    return spark.createDataFrame(rows, "model string, ord int, feature string, importance double")


def metric_rows(spark: SparkSession, val_metrics: dict[str, dict]) -> DataFrame:
    """``(ord, model, metric, value)`` of the validation metrics."""
    rows = [
        (i, model, name, float(record[name]))
        for i, (model, record) in enumerate(val_metrics.items())
        for name in SCALARS
    ]
    return spark.createDataFrame(rows, "ord int, model string, metric string, value double")
