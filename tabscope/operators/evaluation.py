"""Multiclass evaluation over a fixed list of class codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, ratio
from tabscope.functions.ordering import order_cuts

SCALARS = (
    "accuracy",
    "precision_macro",
    "precision_weighted",
    "recall_macro",
    "recall_weighted",
    "f1_macro",
    "f1_weighted",
)


def pair_counts(df: DataFrame, y: str = "y", yp: str = "yp") -> DataFrame:
    """Rows per true and predicted code; all metrics but the AUC follow from these."""
    return df.groupBy(col(y).alias("y_true"), col(yp).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _codes(spark: SparkSession, labels: list[int]) -> DataFrame:
    codes = [(i, int(c)) for i, c in enumerate(labels)]
    return spark.createDataFrame(codes, "ord int, code int")


def confusion_matrix(counts: DataFrame, labels: list[int]) -> DataFrame:
    """One cell per ordered pair of ``labels``, 0 where no row falls."""
    every = F.array(*[F.lit(int(c)) for c in labels])
    grid = _codes(counts.sparkSession, labels).select(
        F.col("code").alias("y_true"), F.explode(every).alias("y_pred")
    )
    return (
        grid.join(counts, ["y_true", "y_pred"], "left")
        .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def confusion_intensity(matrix: DataFrame) -> DataFrame:
    """Each cell over its row's maximum, the shade of a heat map."""
    peak = F.max("n").over(Window.partitionBy("y_true"))
    return matrix.withColumn("row_max", peak).withColumn(
        "intensity", F.col("n") / F.greatest("row_max", F.lit(1))
    )


def class_scores(counts: DataFrame, labels: list[int]) -> DataFrame:
    """Precision, recall, F1 and support of each code; 0 where undefined.

    Rows whose other code is outside ``labels`` still count against a class.
    """
    spark = counts.sparkSession
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("code"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("y_pred").alias("code"),
                    F.lit(0).cast("long").alias("actual"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("tp"),
                ),
            )
        )
    )
    sums = sides.groupBy("code").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    full = _codes(spark, labels).join(sums, "code", "left").fillna(0)
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("actual"))
    return full.select(
        "ord",
        "code",
        precision.alias("precision"),
        recall.alias("recall"),
        # 2pr/(p+r) in counts, which loses nothing to rounding.
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"),
        F.col("actual").cast("long").alias("support"),
        F.col("predicted").cast("long").alias("predicted"),
        F.col("tp").cast("long").alias("tp"),
    )


def _averages() -> list[Column]:
    out = []
    for name in ("precision", "recall", "f1"):
        out.append(F.avg(name).alias(f"{name}_macro"))
        out.append(
            ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"{name}_weighted")
        )
    return out


def scalar_metrics(counts: DataFrame, labels: list[int]) -> DataFrame:
    """One row: accuracy over all rows, macro and support-weighted averages."""
    accuracy = counts.agg(
        ratio(
            F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.sum("n")
        ).alias("accuracy")
    )
    averages = class_scores(counts, labels).agg(*_averages())
    one = F.lit(1).alias("#one")
    return (
        accuracy.select("*", one).join(averages.select("*", one), "#one").select(*SCALARS)
    )


def classification_report(
    counts: DataFrame, labels: list[int], names: list[str] | None = None
) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages.

    When a row's code is outside ``labels``, accuracy gives way to the micro
    averages over the listed classes.
    """
    names = [str(c) for c in labels] if names is None else names
    scores = class_scores(counts, labels)
    k = len(labels)
    per_class = scores.select(
        "ord",
        F.get(F.array(*[F.lit(n) for n in names]), F.col("ord")).alias("class"),
        "precision",
        "recall",
        F.col("f1").alias("f1_score"),
        "support",
    )
    listed = F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels)
    covered = counts.agg(F.coalesce(F.bool_and(listed), F.lit(True)).alias("covered"))
    tp, predicted, actual = (F.sum(c) for c in ("tp", "predicted", "support"))
    totals = scores.agg(
        *_averages(),
        ratio(tp, predicted).alias("micro_p"),
        ratio(tp, actual).alias("micro_r"),
        ratio(2 * tp, predicted + actual).alias("micro_f"),
        actual.alias("support"),
    )
    one = F.lit(1).alias("#one")
    both = totals.select("*", one).join(covered.select("*", one), "#one")

    def line(offset: int, name: Column, p, r, f1) -> Column:
        return F.struct(
            F.lit(k + offset).alias("ord"),
            name.alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f1.alias("f1_score"),
            F.col("support").cast("long").alias("support"),
        )

    micro = [F.col(c) for c in ("micro_p", "micro_r", "micro_f")]
    lines = [line(0, F.when(F.col("covered"), "accuracy").otherwise("micro avg"), *micro)] + [
        line(i, F.lit(f"{kind} avg"), *[F.col(f"{m}_{kind}") for m in ("precision", "recall", "f1")])
        for i, kind in ((1, "macro"), (2, "weighted"))
    ]
    return per_class.union(both.select(F.inline(F.array(*lines))))


def roc_auc_by_class(df: DataFrame, y: str, probabilities: str, labels: list[int]) -> DataFrame:
    """``(code, positives, negatives, auc)`` of each class against the rest.

    Equal scores count half. Rows first fold to counts per class and score. The
    negatives below a score are then summed inside ever coarser cuts of the
    scores: of those that share 36 leading bits, of the cuts that share 18, and
    of the powers of two. No window holds a whole class, whatever its size, and
    nothing about the scores needs to be known first. AUC is NULL for a class
    that is absent or alone.
    """
    codes = F.array(*[F.lit(int(c)) for c in labels])
    pairs = df.select(
        col(y).alias("y"),
        F.inline(F.arrays_zip(codes.alias("code"), col(probabilities).alias("score"))),
    )
    hit = F.col("y") == F.col("code")
    scores = pairs.groupBy("code", "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    # Counts in double: their products outgrow a long at full scale.
    keys = ["code", "power", "coarse", "fine"]
    level = scores.select(
        "code", "score", "pos", "neg",
        *[c.alias(n) for c, n in zip(order_cuts(F.col("score")), keys[1:], strict=True)],
        (F.col("pos").cast("double") * F.col("neg") / 2).alias("won"),
    )
    for order in ("score", "fine", "coarse", "power"):
        keys = [k for k in keys if k != order]
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("neg").over(before), F.lit(0))
        level = (
            level.withColumn("won", F.col("won") + F.col("pos").cast("double") * below)
            .groupBy(*keys)
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
        )
    area = F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg").cast("double"))
    return level.select("code", F.col("pos").alias("positives"), F.col("neg").alias("negatives"), area.alias("auc"))


def roc_auc_macro(by_class: DataFrame) -> DataFrame:
    """Mean over the classes; NULL as soon as one class has no AUC."""
    return by_class.agg(
        F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc_ovr_macro")
    )


def sums_to_one(df: DataFrame, probabilities: str) -> Column:
    """Aggregate: whether every row's probabilities add up to 1 (to about 1e-5)."""
    total = F.aggregate(col(probabilities), F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.bool_and(F.abs(total - 1) <= F.lit(1e-8) + 1e-5 * F.abs(total)), F.lit(True))


def evaluate(
    df: DataFrame,
    labels: list[int],
    y: str = "y",
    yp: str = "yp",
    probabilities: str | None = None,
) -> DataFrame:
    """One row with all scalar metrics; the AUC is NULL without valid probabilities."""
    metrics = scalar_metrics(pair_counts(df, y, yp), labels)
    if probabilities is None:
        return metrics.withColumn("roc_auc_ovr_macro", F.lit(None).cast("double"))
    valid = df.agg(sums_to_one(df, probabilities).alias("valid"))
    auc = roc_auc_macro(roc_auc_by_class(df, y, probabilities, labels))
    one = F.lit(1).alias("#one")
    return (
        metrics.select("*", one)
        .join(auc.select("*", one), "#one")
        .join(valid.select("*", one), "#one")
        .select(*SCALARS, F.when(F.col("valid"), F.col("roc_auc_ovr_macro")).alias("roc_auc_ovr_macro"))
    )


def model_comparison(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Metric by model, from ``(model, metric, value)``; a missing value shows as 0."""
    chart = ("accuracy", "precision_macro", "recall_macro", "f1_macro")
    return (
        metrics.filter(F.col("metric").isin(*chart))
        .groupBy("metric")
        .pivot("model", models)
        .agg(F.max("value"))
        .fillna(0.0)
    )


def select_best(metrics: DataFrame, metric: str) -> DataFrame:
    """The model with the highest ``metric``, the first listed on a tie.

    ``metrics`` is ``(ord, model, metric, value)``.
    """
    if metric not in SCALARS:
        raise ValueError(f"unknown selection metric {metric!r}; use one of {list(SCALARS)}")
    return (
        metrics.filter(F.col("metric") == metric)
        .orderBy(F.desc_nulls_last("value"), "ord")
        .limit(1)
        .select("model", "metric", "value")
    )
