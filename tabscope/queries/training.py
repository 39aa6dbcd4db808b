"""Queries of training and model scoring on the embedding table.

What a fitted model answers is compared by rows only; what must hold of any
fitted model (counts, parameters, totals, consistency) is compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.evaluation import evaluate
from tabscope.operators.scoring import top_n
from tabscope.plans.preprocessing import preprocess_table
from tabscope.plans.scoring import load_bundle, model_info, score
from tabscope.plans.trainers import PROBABILITY
from tabscope.plans.training import (
    TrainingRun,
    importance_rows,
    metric_rows,
    predicted,
    train_candidates,
)
from tabscope.queries import query
from tabscope.queries.fixtures import split_sql, table
from tabscope.session import shared_path
from tabscope.sources.tables import read_split
from tabscope.streaming import jobs

DIMENSIONS = 64


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as 64 number columns with a class name."""
    return spread(table(spark, sf, "embeddings"))


def spread(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        "vec_id",
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(DIMENSIONS)],
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("class"),
    )


def processed(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Folders of the processed table and of the models, preprocessing included."""
    models, output = shared_path(spark, "models"), shared_path(spark, "processed")
    preprocess_table(
        vectors(spark, sf), output, f"{models}/preprocessing", label="class", key="vec_id"
    )
    return output, models


def trained(
    spark: SparkSession, sf: str, only: tuple[str, ...] | None = None
) -> tuple[TrainingRun, str, str]:
    """A training run and its folders of models and of the processed table."""
    output, models = processed(spark, sf)
    run = train_candidates(spark, output, f"{models}/preprocessing", models, only=only)
    return run, models, output


def _validation(spark: SparkSession, sf: str, model: str) -> DataFrame:
    run = trained(spark, sf, (model,))[0]
    return metric_rows(spark, run.summary["val_metrics"]).drop("ord")


@query("train_random_forest")
def _(spark, sf):
    return _validation(spark, sf, "random_forest")


@query("train_boosted_depth6")
def _(spark, sf):
    return _validation(spark, sf, "boosted_depth6")


@query("train_boosted_wide")
def _(spark, sf):
    """Leaf-wise growth, wide where the gain is."""
    return _validation(spark, sf, "boosted_leafwise")


@query("train_compare")
def _(spark, sf):
    run = trained(spark, sf)[0]
    return metric_rows(spark, run.summary["val_metrics"])


@query("test_evaluation")
def _(spark, sf):
    run, _, output = trained(spark, sf)
    test = read_split(spark, output, "test")
    codes = list(range(len(run.summary["label_mapping"])))
    scored = predicted(test, run.summary["feature_columns"], "class", run.best)
    return evaluate(scored, codes, probabilities=PROBABILITY)


@query("feature_importance")
def _(spark, sf):
    return importance_rows(spark, trained(spark, sf)[0].summary)


@query("top_features")
def _(spark, sf):
    rows = importance_rows(spark, trained(spark, sf)[0].summary)
    return top_n(rows, "model", "importance", "ord", 20)


@query("training_summary")
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    s = load_bundle(spark, models, run.version).training_summary(spark)
    rows = [
        (split, label, n, s["best_model_type"], s["version"])
        for split, counts in s["class_distribution"].items()
        for label, n in counts.items()
    ]
    return spark.createDataFrame(
        rows, "split string, label string, n long, best_model_type string, version string"
    )


@query("model_persist")
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    bundle = load_bundle(spark, models, run.version)
    rows = [
        (bundle.metadata["model_type"], bundle.metadata["version"], m, float(v))
        for m, v in bundle.metadata["metrics"].items()
    ]
    return spark.createDataFrame(rows, "model_type string, version string, metric string, value double")


@query("load_bundle")
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    bundle = load_bundle(spark, models)
    return bundle.preprocessing.parameters(spark)


@query("model_info")
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    info = model_info(spark, load_bundle(spark, models, run.version))
    return info.select(
        "model_type",
        "model_version",
        F.size("feature_names").alias("n_features"),
        F.concat_ws(",", "label_classes").alias("label_classes"),
        F.col("metrics")["accuracy"].alias("accuracy"),
    )


@query("score_batch")
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    bundle = load_bundle(spark, models, run.version)
    scored = score(vectors(spark, sf), bundle, keep=("vec_id", "class"))
    return scored.select(
        "vec_id", "class", "predicted_class", "confidence", "model_version"
    )


@query("stream_score_trees", "select true as same, count(*) n from embeddings")
def _(spark, sf):
    """A stream of feature rows scored by a trained version's trees: what batch scoring answers."""
    _, models, _ = trained(spark, sf)
    bundle, path = load_bundle(spark, models), shared_path(spark, "stream")
    schema = table(spark, sf, "embeddings").schema
    arrivals = spread(jobs.stream_table(spark, sf, schema, "embeddings.parquet"))
    # By micro-batches, as a stored forest takes tables.
    jobs.append_batches(arrivals, lambda batch: score(batch, bundle, keep=("vec_id",)), f"{path}/out", f"{path}/checkpoint")
    batch = score(vectors(spark, sf), bundle, keep=("vec_id",)).select("vec_id", F.col("confidence").alias("c"), F.col("predicted_class").alias("p"))
    streamed = spark.read.parquet(f"{path}/out").select("vec_id", "confidence", "predicted_class")
    both = streamed.join(batch, "vec_id", "full")
    same = F.col("c").eqNullSafe(F.col("confidence")) & F.col("p").eqNullSafe(F.col("predicted_class"))
    return both.groupBy(same.alias("same")).agg(F.count("*").alias("n"))


VECTORS = f"""vectors as (select vec_id, embedding, 'class ' || label as class from embeddings),
{split_sql('vectors', 'class', 'vec_id')}"""
MODELS = ("random_forest", "boosted_depth6", "boosted_leafwise")


@query(
    "training_counts",
    f"with {VECTORS} select split, class as label, count(*) n from placed group by all",
)
def _(spark, sf):
    """Rows per part and class, from the summary stored with the trained model."""
    run, models, _ = trained(spark, sf)
    counts = load_bundle(spark, models, run.version).training_summary(spark)["class_distribution"]
    rows = [(split, label, n) for split, own in counts.items() for label, n in own.items()]
    return spark.createDataFrame(rows, "split string, label string, n long")


@query(
    "bundle_parameters",
    f"""with {VECTORS}, long as (select unnest(range({DIMENSIONS}))::int ord, unnest(embedding)::double v
      from placed where split = 'train')
    select ord, 'e' || ord as feature, round(quantile_cont(v, 0.5), 6) as "median",
      round(avg(v), 6) mean, round(stddev_pop(v), 6) as "scale" from long group by ord""",
)
def _(spark, sf):
    """Medians, means and scales of the training part, from the loaded bundle."""
    run, models, _ = trained(spark, sf)
    fitted = load_bundle(spark, models, run.version).preprocessing.parameters(spark)
    return fitted.select("ord", "feature", *[F.round(c, 6).alias(c) for c in ("median", "mean", "scale")])


@query(
    "model_facts",
    f"""select {DIMENSIONS} n_features, string_agg(distinct 'class ' || label, ',' order by 'class ' || label)
      label_classes, true as measured from embeddings""",
)
def _(spark, sf):
    run, models, _ = trained(spark, sf)
    info = model_info(spark, load_bundle(spark, models, run.version))
    return info.select(
        F.size("feature_names").alias("n_features"),
        F.concat_ws(",", F.array_sort("label_classes")).alias("label_classes"),
        F.col("metrics")["accuracy"].between(0.0, 1.0).alias("measured"),
    )


@query(
    "importance_facts",
    f"select unnest({list(MODELS)}) as model, {DIMENSIONS}::bigint n_features, 1.0::double total, true as positive "
    "from (select count(*) from embeddings)",
)
def _(spark, sf):
    """Every candidate weighs every feature, and its weights add up to one."""
    rows = importance_rows(spark, trained(spark, sf)[0].summary)
    return rows.groupBy("model").agg(
        F.countDistinct("feature").alias("n_features"),
        F.round(F.sum("importance"), 9).alias("total"),
        (F.min("importance") >= 0).alias("positive"),
    )


@query(
    "score_facts",
    "select vec_id, 'class ' || label as class, true as known, true as sums_to_one, true as largest from embeddings",
)
def _(spark, sf):
    """Each prediction names a class, the one of the largest probability, and the probabilities add up to one."""
    run, models, _ = trained(spark, sf)
    bundle = load_bundle(spark, models, run.version)
    p = F.map_values("class_probabilities")
    return score(vectors(spark, sf), bundle, keep=("vec_id", "class")).select(
        "vec_id",
        "class",
        F.col("predicted_class").isin(bundle.classes).alias("known"),
        (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        (
            (F.col("confidence") == F.array_max(p))
            & (F.element_at("class_probabilities", F.col("predicted_class")) == F.col("confidence"))
        ).alias("largest"),
    )
