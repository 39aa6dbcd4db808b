from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import column_stats, correlation, duplicates
from tabscope.operators.quantiles import approximate_quantiles, exact_quantiles
from tabscope.operators.summary import summary_statistics

INF = float("inf")


def names(df):
    return [r["column"] for r in df.orderBy("ord").collect()]


def profile_of(spark, **columns):
    rows = list(zip(*columns.values()))
    schema = ", ".join(f"{c} double" for c in columns)
    return column_stats.column_profile(spark.createDataFrame(rows, schema))


def test_constant_rules(spark):
    nan = float("nan")
    p = profile_of(
        spark,
        all_missing=[nan, None, nan],
        one_and_missing=[1.0, None, 1.0],
        same=[2.0, 2.0, 2.0],
        inf=[INF, INF, INF],
        both_inf=[INF, -INF, INF],
        varies=[1.0, 2.0, 3.0],
    )
    assert names(column_stats.constant_columns(p)) == ["all_missing", "same", "inf"]


def test_constant_text_and_empty_table(spark):
    df = spark.createDataFrame([("a", True), ("a", False)], "t string, b boolean")
    assert names(column_stats.constant_columns(column_stats.column_profile(df))) == ["t"]
    empty = spark.createDataFrame([], "t string, x double")
    p = column_stats.column_profile(empty)
    assert names(column_stats.constant_columns(p)) == ["t", "x"]
    assert p.first().pct_missing == 0.0


def test_anomalies_are_found(small_profile):
    missing = {r["column"]: r["count"] for r in small_profile.missing.collect()}
    assert missing == {"Bytes In": 8, "Size": 20}
    infinite = {r["column"]: r["count"] for r in small_profile.infinite.collect()}
    assert infinite == {"Ratio/s": 13}
    assert names(small_profile.constant) == ["Flags"]
    assert "Mode" in names(small_profile.low_variance)
    assert small_profile.duplicates.first().asDict() == {
        "duplicate_rows": 9,
        "duplicate_pct": round(9 / 529 * 100, 4),
    }
    top = small_profile.correlated.first()
    assert (top.feature_a, top.feature_b) == ("Bytes Out", "Twin")


def test_describe_matches_pandas(small_profile, capture):
    want = capture.rename(columns=str.strip).describe()
    for r in small_profile.summary.collect():
        for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
            expected, got = want[r["column"]][stat], r[stat]
            if np.isnan(expected):
                assert got is None
            else:
                assert got == pytest.approx(expected, rel=1e-12), (r["column"], stat)


def test_replace_infinite(spark):
    df = spark.createDataFrame([(1.0, INF), (INF, -INF), (-INF, 2.0), (4.0, 0.0)], "x double, y double")
    both = column_stats.replace_infinite(df)
    assert both.filter("x is null").count() == 2 and both.filter("y is null").count() == 2
    one = column_stats.replace_infinite(df, ["x"])
    assert one.filter("x is null").count() == 2 and one.filter("y is null").count() == 0
    assert df.filter(F.abs("x") == INF).count() == 2
    with pytest.raises(ValueError):
        column_stats.replace_infinite(df, ["z"])


def test_duplicates_treat_missing_as_equal(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (nan, None), (None, None), (2.0, "a")], "x double, t string")
    assert duplicates.drop_duplicate_rows(df).count() == 3
    assert duplicates.duplicate_rows(df).first().duplicate_rows == 2
    none = spark.createDataFrame([], "x double")
    assert duplicates.duplicate_rows(none).first().asDict() == {"duplicate_rows": 0, "duplicate_pct": 0.0}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3), (2.0, 5.0, 4)], ["a.b", "it's `x` \\ y", "Flow/s"])
    assert names(column_stats.column_profile(df)) == df.columns
    assert summary_statistics(df).count() == 3
    assert correlation.correlations(df).count() == 3


@pytest.fixture(scope="module")
def rough(spark):
    """Heavy ties, wide range, gaps, infinities and an almost empty column."""
    rng = np.random.default_rng(5)
    n = 20_000
    tied = np.where(rng.random(n) < 0.6, 0.0, rng.lognormal(0, 8, n))
    ints = rng.integers(0, 7, n).astype(float)
    gaps = np.where(rng.random(n) < 0.3, np.nan, rng.normal(1e9, 1, n))
    infs = np.where(rng.random(n) < 0.3, np.inf, rng.normal(0, 1, n))
    few = np.full(n, np.nan)
    few[:3] = [3.0, 1.0, 2.0]
    pdf = pd.DataFrame({"tied": tied, "ints": ints, "gaps": gaps, "infs": infs, "few": few, "none": np.nan})
    return pdf, spark.createDataFrame(pdf).repartition(7).persist()


PROBS = (0.0, 0.01, 0.25, 0.5, 0.6, 0.75, 0.999, 1.0)


def expected_quantile(values, p):
    v = np.sort(values[~np.isnan(values)])
    if not len(v):
        return None
    at = p * (len(v) - 1)
    lo = int(at)
    a, b = v[lo], v[min(lo + 1, len(v) - 1)]
    part = at - lo
    return a if part == 0 or a == b else (1 - part) * a + part * b


def test_exact_quantiles(rough):
    pdf, df = rough
    rows = exact_quantiles(df, list(pdf.columns), PROBS).collect()
    assert len(rows) == len(PROBS) * len(pdf.columns)
    for r in rows:
        want = expected_quantile(pdf[r["column"]].to_numpy(), r["prob"])
        if want is None:
            assert r["value"] is None
        else:
            assert r["value"] == pytest.approx(want, rel=1e-12, abs=1e-300), r


def test_quantiles_of_finite_values_only(rough):
    pdf, df = rough
    finite = pdf["infs"][np.isfinite(pdf["infs"])].to_numpy()
    got = exact_quantiles(df, ["infs"], (0.5,), finite_only=True).first()["value"]
    assert got == pytest.approx(np.median(finite), rel=1e-12)


def test_quantiles_of_numbers_of_every_size(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.0, 1.0]])
    v = np.concatenate([v, np.nextafter(1.0, 2) + np.arange(200) * np.spacing(1.0)])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(3)
    ordered = np.sort(v)
    for r in exact_quantiles(df, ["v"], tuple(i / 23 for i in range(24))).collect():
        at = r.prob * (len(v) - 1)
        a, b = ordered[int(at)], ordered[min(int(at) + 1, len(v) - 1)]
        want = a if a == b or at == int(at) else (1 - (at - int(at))) * a + (at - int(at)) * b
        assert r.value == want, r


def test_approximate_quantiles_are_close(rough):
    pdf, df = rough
    got = {r.prob: r.value for r in approximate_quantiles(df, ["ints"]).collect()}
    assert got == {p: np.quantile(pdf["ints"], p) for p in got}


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    n = 3000
    a = rng.normal(1e8, 1, n)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 0.1, n), "c": rng.normal(size=n), "k": 7.0})
    pdf["d"] = -pdf["c"]
    pdf.loc[rng.choice(n, 700, replace=False), "b"] = np.nan
    pdf.loc[rng.choice(n, 500, replace=False), "c"] = np.inf
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.replace([np.inf, -np.inf], np.nan).corr()
    rows = correlation.correlations(df).collect()
    assert len(rows) == 10
    for r in rows:
        expected = want.loc[r.feature_a, r.feature_b]
        if np.isnan(expected):
            assert r.r is None
        else:
            assert r.r == pytest.approx(expected, abs=1e-6)


def test_correlation_of_rows_far_from_the_rest(spark):
    """x is huge just where y is missing; r of their own rows is 1 in a table of any width."""
    t = np.arange(2000.0)
    gap = t % 2 == 0
    pdf = pd.DataFrame({"x": np.where(gap, 1e6, 1 + 0.01 * t), "y": np.where(gap, np.nan, 5 * t)})
    for more in ({}, {"k": 0.1, "a": t % 7, "b": -t, "c": np.where(t < 1500, np.nan, 0.3)}):
        df = spark.createDataFrame(pdf.assign(**more)).repartition(3)
        found = {(r.feature_a, r.feature_b): r.r for r in correlation.correlations(df).collect()}
        assert found["x", "y"] == pytest.approx(1.0, abs=1e-12)
        assert not more or (found["x", "k"] is None and found["b", "c"] is None)


def test_moments_merge_as_if_read_at_once():
    rng = np.random.default_rng(3)
    z = rng.normal(1e7, 1, (900, 4))
    z[rng.random(z.shape) < 0.3] = np.nan
    z[:, 3] = 5.5
    whole = correlation.block_moments(z)
    parts = [correlation.block_moments(p) for p in (z[:0], z[:1], z[1:400], z[400:])]
    total = parts[0]
    for p in parts[1:]:
        total = correlation.merged_moments(total, p)
    assert np.allclose(total, whole, rtol=1e-9, atol=1e-6)
    assert (total[4][[2, 4, 5]] == 0).all()


def test_correlation_needs_two_columns(spark):
    assert correlation.correlations(spark.range(3)).count() == 0


def test_heatmap_keeps_the_most_varying_columns(spark):
    df = spark.range(50).selectExpr(*[f"cast(id * {i + 1} as double) c{i}" for i in range(5)])
    p = column_stats.column_profile(df)
    assert correlation.heatmap_columns(df, p, limit=2) == ["c4", "c3"]
    assert correlation.heatmap_columns(df, p) == df.columns


def test_large_whole_numbers_are_told_apart(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "x long")
    assert names(column_stats.constant_columns(column_stats.column_profile(df))) == []
