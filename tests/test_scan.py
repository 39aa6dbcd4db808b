"""The shared scan, exact quantiles, duplicates by hash, and joins that hot keys don't hold up."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import classes, column_stats, contract, correlation, duplicates, history, quantiles, scan, split
from tabscope.plans import profile as plans
from tabscope.session import shared_path


@pytest.fixture(scope="module")
def mixed(spark):
    """Gaps, infinities, whole numbers beyond doubles, a constant, an empty column and texts."""
    rng = np.random.default_rng(5)
    n = 700
    big = [2**60 + (k % 2) for k in range(n)]
    rows = []
    for k in range(n):
        x = float(np.round(rng.normal() * 10.0 ** rng.integers(-5, 9), 6))
        y = None if k % 7 == 0 else float("nan") if k % 11 == 0 else float("inf") if k % 13 == 0 else float("-inf") if k == 5 else x
        rows.append((k % 50, x, y, big[k], 2**60 + 1, None, 3.5 if k % 3 else None, f"t{k % 4}" if k % 5 else None, "same", -0.0 if k % 2 else 0.0))
    schema = "i int, x double, y double, big long, one_big long, none double, part double, text string, same string, zero double"
    return spark.createDataFrame(rows, schema).repartition(5)


def close(a, b) -> bool:
    if a is None or b is None or isinstance(a, (str, bool)):
        return a == b
    return a == b or a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_scan_equals_the_column_profile(mixed):
    want = {r["column"]: r.asDict() for r in column_stats.column_profile(mixed).collect()}
    got = {r["column"]: r.asDict() for r in column_stats.profiled(scan.scan_table(mixed).measures()).collect()}
    assert got.keys() == want.keys()
    for name, row in want.items():
        for key, value in row.items():
            assert close(got[name][key], value), (name, key, got[name][key], value)


def test_scan_equals_the_correlations(mixed):
    names = column_stats.numeric_columns(mixed)
    want = {(r.feature_a, r.feature_b): r.r for r in correlation.correlations(mixed).collect()}
    found = scan.scan_table(mixed, with_pairs=True)
    got = {(r.feature_a, r.feature_b): r.r for r in correlation.coefficients(found.pair_moments(), names).collect()}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)


def test_scan_of_no_rows(mixed):
    empty = mixed.limit(0)
    rows = column_stats.profiled(scan.scan_table(empty, with_pairs=True, with_keys=True).measures()).collect()
    assert len(rows) == 10 and all(r.n_rows == 0 and r.n_known == 0 for r in rows)
    assert all(r.value is None for r in quantiles.exact_quantiles(empty, ["x", "y"]).collect())


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, 1.0000000000000002, 7e8, np.inf])
    keys = scan.order_keys(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert np.array_equal(scan.from_keys(keys), x + 0.0)
    assert set(scan.leading(keys[[0, -1]], 16).tolist()) == set(scan.ENDLESS)
    assert not set(scan.leading(scan.order_keys(np.array([-1.7e308, 1.7e308])), 16).tolist()) & set(scan.ENDLESS)


@pytest.mark.parametrize("cut_values", [1 << 18, 3, 0])
@pytest.mark.parametrize("finite_only", [False, True])
def test_quantiles_at_any_size_of_cut(mixed, monkeypatch, cut_values, finite_only):
    """Cuts are refined up to all 64 bits, where a value may be held by any number of rows."""
    monkeypatch.setattr(quantiles, "CUT_VALUES", cut_values)
    names, probs = ["i", "x", "y", "part", "none", "zero", "big"], (0.0, 0.1, 0.5, 0.77, 1.0)
    rows = mixed.select(*names).toPandas()
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(mixed, names, probs, finite_only=finite_only).collect()}
    for name in names:
        values = pd.to_numeric(rows[name]).astype(float)
        values = np.sort(values[np.isfinite(values)] if finite_only else values.dropna())
        for p in probs:
            if not len(values):
                assert got[name, p] is None
                continue
            at = p * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            want = low if at == int(at) or low == high else (1 - (at - int(at))) * low + (at - int(at)) * high
            assert close(got[name, p], float(want)) or (np.isnan(want) and np.isnan(got[name, p])), (name, p)


def test_wide_tables_are_scanned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SCAN_COLUMNS", 3)
    df = spark.range(11).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(8)])
    rows = quantiles.exact_quantiles(df, df.columns, (0.5,)).collect()
    assert [(r["ord"], r["column"], r["value"]) for r in sorted(rows)] == [(k, f"c{k}", 5.0 * k) for k in range(8)]


class Counted:
    """A table that counts how often its rows are computed."""

    def __init__(self, spark, df):
        self.seen = spark.sparkContext.accumulator(0)
        seen = self.seen

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        self.n = df.count()
        self.df = df.mapInArrow(run, df.schema)

    @property
    def passes(self) -> float:
        return self.seen.value / self.n


def test_profile_takes_four_passes(spark, mixed):
    """SURVEY R-05: one pass for the columns, their pairs and leading bits, one each for quartiles, duplicates, classes."""
    table = Counted(spark, mixed.withColumn("Label", F.col("same")))
    plans.build_profile(table.df)
    assert 3 <= table.passes <= 5  # duplicates read again what repeats


def test_split_reads_the_rows_once(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("string").alias("c"), F.rand(1).alias("x"))
    table = Counted(spark, rows)
    placed = split.stratified_split(table.df, "c")
    assert {r["split"]: r["count"] for r in placed.groupBy("split").count().collect()} == {"train": 279, "val": 61, "test": 60}
    assert table.passes == 1
    again = split.stratified_split(rows.repartition(7), "c")
    assert sorted(placed.collect()) == sorted(again.collect())


def test_duplicates(spark, monkeypatch):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (1, "a", None), (1, "a", float("nan")), (None, None, None), (None, None, None), (2, "a", 1.0)] * 2
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(4)
    for told in (1_000_000, 0):
        monkeypatch.setattr(duplicates, "TOLD_HASHES", told)
        got = duplicates.duplicate_rows(df).first()
        assert (got.duplicate_rows, got.duplicate_pct) == (10, round(100 * 10 / 14, 4))
    assert tuple(duplicates.duplicate_rows(df.limit(0)).first()) == (0, 0.0)


def test_duplicates_store_one_number_of_a_repeated_row(spark, monkeypatch):
    stored, plain = [], duplicates.stage_table
    monkeypatch.setattr(duplicates, "stage_table", lambda df, purpose: stored.append(plain(df, purpose)) or stored[-1])
    df = spark.range(20).unionByName(spark.range(5))
    got = duplicates.duplicate_rows(df).first()
    assert (got.duplicate_rows, got.duplicate_pct) == (5, 20.0)
    assert [(t.count(), [kind for _, kind in t.dtypes]) for t in stored] == [(5, ["bigint"])]


def test_rows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "row_hashes", lambda columns: [F.lit(1).cast("long"), F.pmod(columns[0], F.lit(2)).cast("long")])
    df = spark.range(20).unionByName(spark.range(5))
    assert duplicates.duplicate_rows(df).first().duplicate_rows == 5


def test_hot_classes_are_dealt_out(spark, monkeypatch):
    """Beyond the broadcast, a class of a third of the rows goes to many tasks and light ones stay whole."""
    monkeypatch.setattr(classes, "BROADCAST_CLASSES", 10)
    monkeypatch.setattr(classes, "KEY_ROWS", 500)
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).cast("string").alias("c"))
    table = spark.range(1000).select(F.col("id").cast("string").alias("#class"), (F.col("id") * 2).alias("code"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = classes.join_classes(rows, table, 1000, (F.col("c"), "#class"), "left")
        parts = joined.filter("c = '0'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert joined.count() == 9000 and joined.filter("code != 2 * cast(c as int) or code is null").count() == 0
    assert parts >= 4
    same = classes.join_classes(rows, table.withColumnRenamed("#class", "c"), 1000, "c")
    assert same.columns == ["id", "c", "code"] or set(same.columns) == {"id", "c", "code"}
    assert same.count() == 9000


def test_each_batch_has_its_own_salts(spark, monkeypatch):
    monkeypatch.setattr(contract, "SALT_RECORDS", 100)
    rows = spark.range(3000).select(
        F.col("id").alias("p"),
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("b"),
        (F.col("id") % 701 != 0).alias("valid"),
        F.concat(F.lit("bad "), F.col("id").cast("string")).alias("detail"),
    )
    checked = rows.withColumn("detail", F.when(~F.col("valid"), F.col("detail")))
    got = contract.check_batches(checked, "b", "p").collect()
    assert len(got) == 3000
    first: dict[int, int] = {}
    for r in sorted(got, key=lambda r: r.p):
        if not r.valid:
            first.setdefault(r.b, r.p)
    assert all(r.batch_valid == (r.b not in first) for r in got)
    assert all(r.batch_detail == (f"bad {first[r.b]}" if r.b in first else None) for r in got)


def test_newest_history_reads_the_last_days(spark):
    path = shared_path(spark, "history")
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.timestamp_seconds(F.col("id") * 8640).alias("ts"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("model_version", "string"), ("predicted_class", "string"))],
        F.lit(0.5).alias("confidence"),
        F.lit(1).cast("long").alias("count"),
        F.lit(None).cast("map<string,bigint>").alias("class_breakdown"),
    )
    history.append_history(rows, path)
    history.append_history(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp")), path)
    latest = history.latest_history(spark, path, 25)
    assert [r.id for r in latest.collect()] == [str(k) for k in range(2999, 2974, -1)]
    files = {f.split("day=")[1].split("/")[0] for f in latest.inputFiles()}
    assert len(files) <= 4
    assert history.latest_history(spark, path, 10_000).count() == 3001 == history.read_history(spark, path).count()
    assert history.latest_history(spark, path + "-none", 5).count() == 0
