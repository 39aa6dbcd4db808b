from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabscope.operators import classes
from tabscope.operators.preprocess import FittedPreprocessing, fit
from tabscope.operators.split import (
    RareClassesError,
    split_allocation,
    stratified_split,
)
from tabscope.plans.preprocessing import preprocess_csv
from tabscope.session import shared_path

INF = float("inf")

# Published class totals and their split, the golden case of the allocation.
GOLDEN = {
    "BENIGN": (417035, 291924, 62555, 62556),
    "DoS GoldenEye": (10286, 7200, 1543, 1543),
    "DoS Hulk": (172849, 120995, 25927, 25927),
    "DoS Slowhttptest": (5228, 3660, 784, 784),
    "DoS slowloris": (5385, 3769, 808, 808),
    "Heartbleed": (11, 7, 2, 2),
}


def test_golden_allocation(spark):
    counts = spark.createDataFrame([(k, v[0]) for k, v in GOLDEN.items()], "label string, count long")
    got = {r.label: (r.n, r.n_train, r.n_val, r.n_test) for r in split_allocation(counts).collect()}
    assert got == GOLDEN


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds nine rows in ten."""
    return spark.range(5000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 100 == 0, "rare").otherwise("mid").alias("c"),
    )


def test_split_invariants(skewed):
    placed = stratified_split(skewed, "c", key="key").persist()
    assert placed.count() == 5000 and placed.select("key").distinct().count() == 5000
    total = {r.split: r["count"] for r in placed.groupBy("split").count().collect()}
    assert total == {"train": 3500, "val": 750, "test": 750}
    want = {r.label: r for r in split_allocation(classes.class_counts(skewed, "c")).collect()}
    for r in placed.groupBy("c", "split").count().collect():
        assert r["count"] == want[r.c][f"n_{r.split}"]
    again = stratified_split(skewed.repartition(13), "c", key="key")
    assert placed.exceptAll(again).isEmpty()
    other = stratified_split(skewed, "c", key="key", seed=7)
    assert not placed.exceptAll(other).isEmpty()


def test_split_order_is_the_seeded_hash(skewed):
    placed = stratified_split(skewed, "c", key="key")
    order = F.md5(F.concat(F.lit("42|"), F.col("key").cast("string")))
    spans = placed.groupBy("c", "split").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    for label in ("hot", "mid", "rare"):
        span = {r.split: (r.lo, r.hi) for r in spans.filter(F.col("c") == label).collect()}
        assert span["test"][1] < span["val"][0] and span["val"][1] < span["train"][0]


def test_split_by_whole_rows(spark):
    df = spark.range(200).selectExpr("id % 17 a", "cast(id as double) b", "if(id % 2 = 0, 'x', 'y') c")
    placed = stratified_split(df, "c")
    assert placed.count() == 200
    assert placed.filter("split = 'test'").count() == 30


def test_split_errors(spark, skewed):
    with pytest.raises(ValueError, match="must sum to 1.0"):
        stratified_split(skewed, "c", (0.5, 0.2, 0.2), key="key")
    few = spark.createDataFrame([(i, "a" if i < 18 else "b") for i in range(20)], "key long, c string")
    with pytest.raises(RareClassesError, match="'b': 2"):
        stratified_split(few, "c", key="key")
    gap = few.union(spark.createDataFrame([(99, None)], "key long, c string"))
    with pytest.raises(ValueError, match="missing"):
        stratified_split(gap, "c", key="key")
    tied = spark.createDataFrame([(1, "a")] * 30, "key long, c string")
    with pytest.raises(Exception, match="not unique"):
        stratified_split(tied, "c", key="key").collect()


def frame(spark, values, label="a", column="x"):
    return spark.createDataFrame([(v, label) for v in values], f"{column} double, Label string")


def test_median_ignores_infinite_and_missing(spark):
    df = frame(spark, [10.0, 20.0, 30.0, INF, float("nan")] * 4)
    fitted = fit(df)
    assert fitted.features[0].median == 20.0
    moved = [r.x for r in fitted.transform_features(df).collect()]
    assert len(moved) == 20 and sum(moved) == pytest.approx(0, abs=1e-9)
    assert sum(v * v for v in moved) / 20 == pytest.approx(1)


def test_other_rows_do_not_move_the_fit(spark):
    train = frame(spark, [10.0, 10.0, 12.0, 8.0] * 5)
    fitted = fit(train)
    far = fitted.transform_features(frame(spark, [10000.0])).first().x
    assert abs(far) > 100
    assert fit(train) == fitted


def test_nothing_left(spark):
    with pytest.raises(ValueError, match="no features left"):
        fit(frame(spark, [1.0, 1.0, 1.0]))
    with pytest.raises(ValueError, match="no features left"):
        fit(spark.createDataFrame([("t", "a")], "t string, Label string"))


def test_column_without_finite_values(spark):
    df = spark.createDataFrame([(INF, 1.0, "a"), (-INF, 2.0, "b"), (INF, 3.0, "a")], "x double, y double, Label string")
    with pytest.raises(ValueError, match="no median"):
        fit(df)


def test_one_value_and_gaps_becomes_zeros(spark):
    df = spark.createDataFrame([(5.0, 1.0, "a"), (None, 2.0, "b"), (5.0, 4.0, "a")], "x double, y double, Label string")
    fitted = fit(df)
    assert fitted.feature_names == ["x", "y"] and fitted.features[0].scale == 1.0
    assert {r.x for r in fitted.transform_features(df).collect()} == {0.0}


def test_labels_and_unknown_values(spark):
    df = spark.createDataFrame([(float(i), c) for i, c in enumerate("bcaacb")], "x double, Label string")
    fitted = fit(df)
    assert fitted.metadata()["label_mapping"] == {"0": "a", "1": "b", "2": "c"}
    coded = fitted.transform(df)
    assert coded.columns == ["x", "Label"]
    back = fitted.decode(coded, "Label", "name")
    assert sorted(r.name for r in back.collect()) == ["a", "a", "b", "b", "c", "c"]
    new = spark.createDataFrame([(1.0, "zzz")], "x double, Label string")
    with pytest.raises(Exception, match="label not seen in training: zzz"):
        fitted.transform(new).collect()
    with pytest.raises(ValueError, match="lacks fitted features"):
        fitted.transform_features(spark.range(1))
    with pytest.raises(Exception, match="unknown class code"):
        fitted.decode(spark.createDataFrame([(9,)], "Label int"), "Label").collect()


def test_save_and_load(spark, flow_table):
    fitted = fit(flow_table, "Label")
    path = shared_path(spark, "fitted")
    fitted.save(spark, path)
    loaded = FittedPreprocessing.load(spark, path)
    assert loaded == fitted
    a, b = fitted.transform_features(flow_table), loaded.transform_features(flow_table)
    assert a.exceptAll(b).isEmpty() and a.count() == 529


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "c string")
    got = {r.label: r.weight for r in classes.balanced_weights(df, "c").collect()}
    assert got == {"a": 8 / 12, "b": 2.0}


def test_class_distribution(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "c string")
    rows = [(r.label, r["count"], r.pct) for r in classes.class_distribution(df, "c").collect()]
    assert rows == [("a", 2, 50.0), ("b", 1, 25.0), ("nan", 1, 25.0)]
    assert classes.class_distribution(df, "other") is None
    assert [r.label for r in classes.class_counts(df, "c").orderBy("label").collect()] == ["a", "b"]


def test_label_order_is_numeric(spark):
    df = spark.createDataFrame([("2", "c"), ("0", "a"), ("10", "d"), ("1", "b")], "code string, label string")
    assert [r.label for r in classes.ordered_labels(df).collect()] == ["a", "b", "c", "d"]


def test_job_from_csv(spark, capture_csv):
    out, artifacts = shared_path(spark, "processed"), shared_path(spark, "artifacts")
    run = preprocess_csv(spark, capture_csv, out, artifacts, label="Label")
    s = run.summary
    assert (s["n_rows_input"], s["n_rows_after_dedup"], s["n_duplicate_rows_removed"]) == (529, 520, 9)
    assert s["n_train_rows"] + s["n_val_rows"] + s["n_test_rows"] == 520
    assert "Flags" in run.fitted.dropped_constant
    assert "Mode" in run.fitted.dropped_low_variance + run.fitted.dropped_constant
    table = spark.read.parquet(out)
    assert table.columns == [*run.fitted.feature_names, "Label", "split"]
    train = table.filter("split = 'train'")
    means = train.select([F.avg(f"`{c}`") for c in run.fitted.feature_names]).first()
    assert all(abs(m) < 1e-9 for m in means)
    gaps = table.select([F.count_if(F.col(f"`{c}`").isNull()) for c in run.fitted.feature_names])
    assert sum(gaps.first()) == 0
    # Fitting on the training part again gives the same parameters.
    assert FittedPreprocessing.load(spark, artifacts) == run.fitted
