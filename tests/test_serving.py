from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabscope.functions import probability, text
from tabscope.operators import contract, history, scoring
from tabscope.operators.preprocess import fit
from tabscope.plans.scoring import Bundle, score, score_requests
from tabscope.queries.fixtures import REQUEST_FEATURES, LinearScorer, request_bundle
from tabscope.session import shared_path, shared_root
from tabscope.streaming import jobs


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.5, 0.5, 0.0],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(probability.argmax(F.col("p"))).collect()] == [1, 0, 2]


def test_predictions_and_ranking(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.3]), (2, [0.4, 0.4, 0.2])], "id int, p array<double>")
    rows = scoring.predictions(df, "p", ["a", "b", "c"], "v3", ("id",)).collect()
    assert [(r.predicted_class, r.confidence, r.model_version) for r in rows] == [
        ("b", 0.5, "v3"), ("a", 0.4, "v3"),
    ]
    assert rows[0].class_probabilities == {"a": 0.2, "b": 0.5, "c": 0.3}
    ranked = scoring.ranked_probabilities(df, "p", ["a", "b", "c"], ("id",)).orderBy("id", "rank")
    assert [r["class"] for r in ranked.collect()] == ["b", "c", "a", "a", "b", "c"]


def test_breakdown(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "predicted_class string")
    got = {r.predicted_class: r["count"] for r in scoring.class_breakdown(df).collect()}
    assert got == {"x": 2, "y": 1}


def test_formats(spark):
    row = spark.createDataFrame([(470975272, 0.98765, None)], "n long, x double, y double").select(
        text.byte_size(F.col("n")).alias("size"),
        text.thousands(F.col("n")).alias("n"),
        text.metric(F.col("x")).alias("x"),
        text.percent(F.col("x")).alias("p"),
        text.metric(F.col("y")).alias("dash"),
        text.title(F.lit("missing_value_matrix")).alias("title"),
    ).first()
    assert tuple(row) == (
        "449.16 MB", "470,975,272", "0.988", "98.8%", "—", "Missing Value Matrix",
    )


def maps(spark):
    rows = [
        (0, 0, {"a": 1.0, "b": 2.0}),
        (1, 0, {"a": 1.0, "z": 2.0, "c": 0.0}),
        (2, 1, {"b": 1.0, "a": 5.0}),
        (3, 2, {}),
    ]
    return spark.createDataFrame(rows, "id int, batch int, features map<string,double>")


def test_contract(spark):
    rows = contract.check_features(maps(spark), ["b", "a"]).orderBy("id").collect()
    assert [r.valid for r in rows] == [True, False, True, False]
    assert rows[1].missing_features == ["b"] and rows[1].unexpected_features == ["c", "z"]
    assert rows[1].detail == "missing features: b — unexpected features: c, z"
    assert rows[3].detail == "missing features: a, b"


def test_one_bad_record_rejects_its_batch(spark):
    checked = contract.check_features(maps(spark), ["b", "a"])
    rows = contract.check_batches(checked, "batch", "id").orderBy("id").collect()
    assert [r.batch_valid for r in rows] == [False, False, True, False]
    assert rows[0].batch_detail == rows[1].detail


def test_quality_gate(spark):
    df = spark.createDataFrame([(0.5, "1"), (1.5, "1"), (0.5, "x"), (None, "1"), (0.5, "NaN")], "c double, v string")
    assert [r.passes for r in contract.quality_gate(df, "c", "v").collect()] == [True] + [False] * 4


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [(float(i % 7), float(i % 5), "xyz"[i % 3]) for i in range(60)]
    fitted = fit(spark.createDataFrame(rows, "a double, b double, c string"), "c")
    return Bundle(fitted, LinearScorer(3), {"version": "v1", "model_type": "linear", "metrics": {}})


def test_scoring_ignores_other_columns_and_labels(spark, bundle):
    df = spark.createDataFrame([(1, 3.0, 1.0, "q"), (2, None, float("inf"), "r")], "id int, b double, a double, other string")
    rows = score(df, bundle, ("id",)).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2]
    for r in rows:
        assert sum(r.class_probabilities.values()) == pytest.approx(1)
        assert r.confidence == max(r.class_probabilities.values())
        assert r.class_probabilities[r.predicted_class] == r.confidence


def test_requests_are_scored_or_rejected(spark, bundle):
    good, bad = score_requests(maps(spark), bundle, keep=("id",))
    assert sorted(r.id for r in good.collect()) == [0, 2]
    assert sorted(r.id for r in bad.collect()) == [1, 3]


def test_requests_keep_a_feature_that_hardly_varies(spark):
    """One far value makes the rest of the column look flat; the fixed model still scores it."""
    sf = shared_path(spark, "events")
    e = F.col("id")
    value = F.when(e == 7, 1e6).otherwise((e % 9).cast("double"))
    events = spark.range(300).select(e.alias("event_id"), (e % 50).alias("user_id"), value.alias("value"), F.concat(F.lit("t"), (e % 5).cast("string")).alias("event_type"))
    events.write.parquet(f"{sf}/events.parquet")
    bundle = request_bundle(spark, sf)
    assert bundle.feature_names == REQUEST_FEATURES
    features = F.create_map(F.lit("user_id"), F.col("user_id").cast("double"), F.lit("value"), F.col("value"))
    maps = events.select("event_id", features.alias("features"))
    good, bad = score_requests(maps, bundle, keep=("event_id",))
    assert good.count() == 300 and bad.count() == 0


def test_history_views(spark):
    rows = [
        (f"{i:04d}", i, "single", "v1", f"class-{i}", 0.9, None, None) for i in range(205)
    ] + [("b1", 1000, "batch", "v1", None, None, 9, {"p": 4, "q": 1, "r": 2, "s": 2})]
    df = spark.createDataFrame(
        rows,
        "id string, t long, kind string, model_version string, predicted_class string, "
        "confidence double, count bigint, class_breakdown map<string,bigint>",
    ).withColumn("ts", F.timestamp_seconds("t"))
    path = shared_path(spark, "history")
    history.append_history(df.filter("t < 100"), path)
    history.append_history(df.filter("t >= 100"), path)
    stored = history.read_history(spark, path)
    latest = history.latest_entries(stored).collect()
    assert len(latest) == 200 and latest[0].id == "b1" and latest[1].id == "0204"
    top = history.top_classes(stored).orderBy("rank").collect()
    assert [(r.predicted_class, r.n) for r in top] == [("p", 4), ("r", 2), ("s", 2)]


def test_stream_equals_batch(spark, bundle):
    source, out = shared_path(spark, "source"), shared_path(spark, "out")
    maps(spark).write.parquet(source)
    stream = jobs.stream_table(spark, source, maps(spark).schema, "*.parquet")
    jobs.append_to(jobs.scored_stream(stream, bundle, ("id",)), f"{out}/scored", f"{out}/c1")
    batch, _ = score_requests(maps(spark), bundle, keep=("id",))
    got = spark.read.parquet(f"{out}/scored").select("id", "predicted_class").collect()
    assert sorted(got) == sorted(batch.select("id", "predicted_class").collect())
    jobs.run_available(jobs.route_requests(stream, bundle, f"{out}/good", f"{out}/bad", ("id",)), f"{out}/c2")
    # A second run finds nothing new and adds nothing.
    jobs.run_available(jobs.route_requests(stream, bundle, f"{out}/good", f"{out}/bad", ("id",)), f"{out}/c2")
    assert sorted(r.id for r in spark.read.parquet(f"{out}/bad").collect()) == [1, 3]
    assert sorted(r.id for r in spark.read.parquet(f"{out}/good").collect()) == [0, 2]


def test_stream_of_a_table_in_one_file_or_many(spark):
    """A table below the path may be one file or a folder of files of any name."""
    source, out = shared_path(spark, "source"), shared_path(spark, "out")
    df = spark.range(40).repartition(4)
    df.write.parquet(f"{source}/many.parquet")
    jobs.append_to(jobs.stream_table(spark, source, df.schema, "many.parquet"), f"{out}/many", f"{out}/c1")
    assert spark.read.parquet(f"{out}/many").count() == 40
    file = spark.read.parquet(f"{source}/many.parquet").inputFiles()[0]
    folder, name = file.rsplit("/", 1)
    jobs.append_to(jobs.stream_table(spark, folder, df.schema, name), f"{out}/one", f"{out}/c2")
    assert spark.read.parquet(f"{out}/one").count() == spark.read.parquet(file).count() > 0


def test_stream_windows_and_repeats(spark):
    source, out = shared_path(spark, "source"), shared_path(spark, "out")
    df = spark.range(48).select(
        (F.col("id") % 24).alias("key"),
        F.timestamp_seconds(1704067200 + (F.col("id") % 24) * 7200).alias("ts"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("predicted_class"),
    )
    df.coalesce(1).write.parquet(source)
    stream = jobs.stream_table(spark, source, df.schema, "*.parquet")
    jobs.update_table(jobs.windowed_breakdown(stream), f"{out}/w", f"{out}/c1")
    current = jobs.current_rows(spark, f"{out}/w", ["window_start", "predicted_class"])
    got = {(r.window_start, r.predicted_class): r["count"] for r in current.collect()}
    want = {(r.window_start, r.predicted_class): r["count"] for r in jobs.windowed_breakdown(df).collect()}
    assert got == want and sum(got.values()) == 48
    jobs.append_to(jobs.without_repeats(stream, ["key"]), f"{out}/d", f"{out}/c2")
    assert spark.read.parquet(f"{out}/d").count() == 24
    assert jobs.without_repeats(df, ["key"]).count() == 24


def test_shared_folder_is_the_sessions_own(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
