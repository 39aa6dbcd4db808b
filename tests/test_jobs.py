from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import column_stats
from tabscope.plans import findings, profile, trainers, training
from tabscope.plans.preprocessing import preprocess_table
from tabscope.plans.scoring import load_bundle, model_info, score
from tabscope.plans.training import best_model, train_candidates
from tabscope.session import shared_path
from tabscope.sources.tables import read_record


def test_findings_name_the_anomalies(small_profile):
    rows = findings.quality_findings(small_profile).orderBy("ord", "item").collect()
    heads = {r.finding: (r.subject, r["count"]) for r in rows if r.item == 0}
    assert heads["missing"] == ("total", 2) and heads["infinite"] == ("total", 1)
    assert heads["duplicate"] == ("total", 9) and heads["imbalance"] == ("total", 3)
    assert rows[-2].subject == "normal"


def test_clean_table_has_no_findings(spark):
    df = spark.range(40).selectExpr("id x", "(id * 7919) % 40 y", "'a' Label")
    p = profile.build_profile(df)
    rows = findings.quality_findings(p).collect()
    none = {r.finding for r in rows if r.subject == "none observed"}
    assert none == {"missing", "infinite", "low_variance", "correlated"}
    steps = [r.action for r in findings.recommended_steps(p).orderBy("step").collect()]
    assert steps == ["drop constant columns", "encode the label and scale the features"]
    assert findings.modelling_challenges(p).count() == 2


def test_profile_job_writes_everything(spark, flow_table):
    out = shared_path(spark, "report")
    written = findings.profile_job(flow_table, out, name="flows")
    record = read_record(spark, written["profile_json"])
    assert record["n_rows"] == 529 and record["n_cols"] == 10
    assert record["summary_statistics"]["Ratio/s"]["std"] is None
    assert record["class_distribution"].keys() == {"normal", "flood", "scan"}
    json.dumps(record)
    wide = spark.read.csv(written["summary_csv"], header=True)
    assert [r.statistic for r in wide.collect()] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert spark.read.csv(written["pairs_csv"], header=True).count() == len(record["highly_correlated_pairs"])
    text = spark.read.text(written["report"], wholetext=True).first().value
    assert "529 rows, 10 columns" in text and "`Ratio/s`" in text
    bins = spark.read.parquet(written["histograms"])
    assert bins.count() == 50 * bins.select("column").distinct().count()
    per_column = bins.groupBy("column").agg(F.sum("count").alias("n")).collect()
    finite = {r["column"]: r["n_finite"] for r in column_stats.column_profile(flow_table).collect()}
    assert all(r.n == finite[r["column"]] for r in per_column)
    assert spark.read.parquet(written["missing_matrix"]).count() == 529
    assert spark.read.parquet(written["correlation_matrix"]).count() == 81


def test_profile_of_a_capture_day(spark, capture_csv):
    raw = capture_csv.rsplit("/", 1)[0]
    written = findings.profile_day(spark, "wednesday", shared_path(spark, "day"), raw_dir=raw)
    text = spark.read.text(written["report"], wholetext=True).first().value
    assert text.startswith("# Profile of wednesday")


def test_profile_without_label(spark):
    p = profile.build_profile(spark.range(5).selectExpr("id x", "id * 2 y"))
    assert p.classes is None and profile.profile_record(p)["label_column"] is None
    assert "imbalance" not in {r.finding for r in findings.quality_findings(p).collect()}


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes of unequal size around centres of their own."""
    rng = np.random.default_rng(0)
    n = 300
    y = rng.choice(3, n, p=[0.7, 0.2, 0.1])
    x = rng.normal(size=(n, 4)) * 0.7
    x[:, 0] += y * 3
    x[:, 1] -= y * 2
    pdf = pd.DataFrame(x, columns=["f.0", "f1", "f2", "f3"])
    pdf["key"], pdf["Label"] = np.arange(n), np.array(["a", "b", "c"])[y]
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def run(spark, separable):
    models, out = shared_path(spark, "models"), shared_path(spark, "processed")
    preprocess_table(separable, out, f"{models}/preprocessing", key="key")
    return train_candidates(spark, out, f"{models}/preprocessing", models, n_trees=5), models, out


def test_every_candidate_learns(run):
    summary = run[0].summary
    assert summary["trained_models"][:3] == ["random_forest", "boosted_depth6", "boosted_leafwise"]
    for name, m in summary["val_metrics"].items():
        assert m["accuracy"] > 0.85, name
        assert m["roc_auc_ovr_macro"] > 0.9, name
    assert summary["best_model_type"] == best_model(summary["val_metrics"], "f1_macro")
    assert summary["version"] == "v1"
    assert sum(map(sum, summary["test_metrics"]["confusion_matrix"])) == summary["n_test_rows"] == 45


def test_importances_cover_the_features(run):
    for values in run[0].summary["feature_importances"].values():
        assert list(values) == ["f.0", "f1", "f2", "f3"]
        assert sum(values.values()) == pytest.approx(1, abs=1e-6)


def test_saved_model_scores_alike(spark, run, separable):
    done, models, _ = run
    bundle = load_bundle(spark, models)
    rows = score(separable, bundle, ("key", "Label")).collect()
    assert len(rows) == 300
    assert sum(r.predicted_class == r.Label for r in rows) > 270
    assert all(sum(r.class_probabilities.values()) == pytest.approx(1, abs=1e-5) for r in rows)
    assert all(r.model_version == "v1" for r in rows)
    assert bundle.training_summary(spark)["version"] == "v1"
    info = model_info(spark, bundle).first()
    assert info.label_classes == ["a", "b", "c"] and info.metrics["accuracy"] > 0.85


def test_probabilities_of_every_kind_add_up(spark, run):
    _, models, out = run
    rows = training.training_rows(training.read_split(spark, out, "train"), ["f.0", "f1", "f2", "f3"], "Label")
    assert rows.agg(F.round(F.sum("#weight"), 6)).first()[0] == 210
    for trainer in (trainers.RandomForestTrainer, trainers.BoostedLeafwiseTrainer):
        p = trainer(n_trees=2, seed=1).fit(rows).probabilities(rows.select("#features", "#label"))
        total = p.select(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b).alias("s"))
        assert total.filter("abs(s - 1) > 1e-5").count() == 0


def test_missing_parts_fail(spark, run):
    _, models, out = run
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, models, "v9")
    with pytest.raises(ValueError, match="unknown selection metric"):
        best_model({"a": {"accuracy": 1.0}}, "speed")
    other = shared_path(spark, "other")
    spark.read.parquet(out).drop("f1").write.partitionBy("split").parquet(other)
    with pytest.raises(ValueError, match="f1"):
        train_candidates(spark, other, f"{models}/preprocessing", models, n_trees=1)


def test_absent_library_is_a_reason(monkeypatch):
    def without(name):
        raise (ImportError if name.startswith("xgboost") else OSError)(f"{name} does not load")

    monkeypatch.setattr(trainers, "import_module", without)
    available, skipped = trainers.available_trainers()
    assert "xgboost" not in available and set(skipped) == {"xgboost", "lightgbm"}
    assert skipped["lightgbm"] == "lightgbm does not load"


def test_library_without_a_spark_trainer_is_a_reason(monkeypatch):
    monkeypatch.setattr(trainers, "import_module", lambda name: None)
    available, skipped = trainers.available_trainers()
    assert "xgboost" in available and "boosted_leafwise" in skipped["lightgbm"]
