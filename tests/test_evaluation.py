from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import evaluation as ev

# Published confusion matrix of the golden case and the metrics that go with it.
MATRIX = [
    [62543, 2, 10, 1, 0, 0],
    [0, 1542, 0, 1, 0, 0],
    [1, 7, 25919, 0, 0, 0],
    [0, 0, 0, 782, 2, 0],
    [1, 0, 0, 5, 802, 0],
    [0, 0, 0, 0, 0, 2],
]
ACCURACY, F1_MACRO, F1_WEIGHTED = 0.9996725605762934, 0.9976027649009613, 0.9996727460621675


@pytest.fixture(scope="module")
def golden(spark):
    cells = [(t, p, n) for t, row in enumerate(MATRIX) for p, n in enumerate(row) if n]
    return spark.createDataFrame(cells, "y_true int, y_pred int, n long")


def test_golden_metrics(golden):
    m = ev.scalar_metrics(golden, list(range(6))).first()
    assert m.accuracy == pytest.approx(ACCURACY, abs=1e-15)
    assert m.f1_macro == pytest.approx(F1_MACRO, abs=1e-14)
    assert m.f1_weighted == pytest.approx(F1_WEIGHTED, abs=1e-14)
    assert m.precision_macro == pytest.approx(0.9970700, abs=1e-7)
    assert m.recall_macro == pytest.approx(0.9981431, abs=1e-7)


def test_golden_matrix_and_report(golden):
    cells = {(r.y_true, r.y_pred): r.n for r in ev.confusion_matrix(golden, list(range(6))).collect()}
    assert [[cells[t, p] for p in range(6)] for t in range(6)] == MATRIX
    report = ev.classification_report(golden, list(range(6))).orderBy("ord").collect()
    assert [r["class"] for r in report] == [*"012345", "accuracy", "macro avg", "weighted avg"]
    assert report[6].f1_score == pytest.approx(ACCURACY)
    assert report[7].f1_score == pytest.approx(F1_MACRO)
    assert report[8].support == sum(map(sum, MATRIX))


def pairs(spark, y, yp):
    return spark.createDataFrame(list(zip(y, yp)), "y int, yp int")


def test_small_exact_cases(spark):
    counts = ev.pair_counts(pairs(spark, [0, 0, 0, 1, 1], [0, 0, 1, 1, 1]))
    assert ev.scalar_metrics(counts, [0, 1]).first().accuracy == 0.8
    counts = ev.pair_counts(pairs(spark, [0, 0, 1, 1], [0, 1, 1, 1]))
    cells = ev.confusion_matrix(counts, [0, 1]).orderBy("y_true", "y_pred").collect()
    assert [r.n for r in cells] == [1, 1, 0, 2]


def test_absent_class_counts_as_zero(spark):
    counts = ev.pair_counts(pairs(spark, [0, 0, 1], [0, 0, 0]))
    m = ev.scalar_metrics(counts, [0, 1, 2]).first()
    assert m.recall_macro == pytest.approx(1 / 3) and m.precision_macro == pytest.approx(2 / 9)
    assert m.recall_weighted == pytest.approx(2 / 3)
    assert ev.confusion_matrix(counts, [0, 1, 2]).count() == 9


def test_codes_outside_the_list(spark):
    counts = ev.pair_counts(pairs(spark, [0, 1, 5, 0], [0, 5, 1, 1]))
    report = ev.classification_report(counts, [0, 1]).orderBy("ord").collect()
    assert report[2]["class"] == "micro avg"
    assert (report[2].precision, report[2].recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert ev.scalar_metrics(counts, [0, 1]).first().accuracy == 0.25


def brute_auc(y, p):
    pos, neg = p[y], p[~y]
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (
        len(pos) * len(neg)
    )


@pytest.mark.parametrize("digits,shift", [(15, 0), (1, 0), (300, 1), (2, 3)])
def test_auc_against_every_pair(spark, digits, shift):
    """Also with scores of many sizes, and with scores of either sign."""
    rng = np.random.default_rng(3)
    n = 600
    y = rng.choice([0, 1, 2], n, p=[0.8, 0.15, 0.05])
    raw = rng.random((n, 3)) ** 6 + np.eye(3)[y] * 0.05
    p = {0: np.round(raw, digits), 1: raw**40, 3: np.round(raw - 0.3, digits)}[shift]
    rows = [(int(a), [float(v) for v in b]) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "y int, p array<double>").repartition(5)
    got = {r.code: r for r in ev.roc_auc_by_class(df, "y", "p", [0, 1, 2]).collect()}
    for c in range(3):
        assert got[c].auc == pytest.approx(brute_auc(y == c, p[:, c]), abs=1e-12)
        assert got[c].positives == (y == c).sum()


def test_auc_is_unknown_without_a_class_or_valid_probabilities(spark):
    rows = [(0, [0.7, 0.2, 0.1]), (1, [0.2, 0.7, 0.1])]
    df = spark.createDataFrame(rows, "y int, p array<double>").withColumn("yp", F.col("y"))
    assert ev.evaluate(df, [0, 1, 2], probabilities="p").first().roc_auc_ovr_macro is None
    assert ev.evaluate(df, [0, 1], probabilities=None).first().roc_auc_ovr_macro is None
    full = df.union(spark.createDataFrame([(2, [0.1, 0.2, 0.7], 2)], df.schema))
    assert ev.evaluate(full, [0, 1, 2], probabilities="p").first().roc_auc_ovr_macro == 1.0
    off = full.withColumn("p", F.transform("p", lambda v: v * 2))
    assert ev.evaluate(off, [0, 1, 2], probabilities="p").first().roc_auc_ovr_macro is None


def test_best_model_and_comparison(spark):
    rows = [
        (0, "a", "f1_macro", 0.5), (1, "b", "f1_macro", 0.9), (2, "c", "f1_macro", 0.9),
        (0, "a", "accuracy", 0.7), (1, "b", "accuracy", 0.6),
    ]
    m = spark.createDataFrame(rows, "ord int, model string, metric string, value double")
    assert ev.select_best(m, "f1_macro").first().model == "b"
    assert ev.select_best(m, "accuracy").first().model == "a"
    with pytest.raises(ValueError):
        ev.select_best(m, "speed")
    chart = {r.metric: (r.a, r.b, r.c) for r in ev.model_comparison(m, ["a", "b", "c"]).collect()}
    assert chart == {"f1_macro": (0.5, 0.9, 0.9), "accuracy": (0.7, 0.6, 0.0)}
