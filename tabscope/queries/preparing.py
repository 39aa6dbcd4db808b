"""Queries of deduplication, split, fit and transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators import classes, column_stats, contract
from tabscope.operators.preprocess import FittedPreprocessing, select_features
from tabscope.operators.split import (
    RareClassesError,
    check_classes,
    split_allocation,
    stratified_split,
)
from tabscope.plans.preprocessing import PreprocessingRun, preprocess_table
from tabscope.queries import query
from tabscope.queries.fixtures import (
    LEDGER,
    LEDGER_FIT,
    LEDGER_KEPT,
    LEDGER_PLACED,
    ledger,
    ledger_fit,
    ledger_placed,
    ledger_train,
    scaled_sql,
    split_sql,
    table,
)
from tabscope.session import shared_path
from tabscope.sources.tables import read_split, write_splits


@query("stratified_split", f"with {LEDGER_PLACED} select key, status, split from placed")
def _(spark, sf):
    return ledger_placed(spark, sf).select("key", "status", "split")


@query(
    "stratified_split_by_priority",
    f"with {split_sql('orders', 'o_orderpriority', 'o_orderkey')} "
    "select o_orderpriority label, split, count(*) n, sum(o_orderkey)::bigint keys "
    "from placed group by all",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    placed = stratified_split(df, "o_orderpriority", key="o_orderkey")
    return placed.groupBy(F.col("o_orderpriority").alias("label"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query(
    "split_allocation",
    f"with {split_sql('events', 'event_type', 'event_id')} select label, n, n_train, n_val, n_test from alloc",
)
def _(spark, sf):
    return split_allocation(classes.class_counts(table(spark, sf, "events"), "event_type"))


@query(
    "split_disjoint",
    "select count(*) n_rows, 0::bigint train_val, 0::bigint train_test, 0::bigint val_test, "
    "0::bigint left_out from orders",
)
def _(spark, sf):
    placed = ledger_placed(spark, sf)
    part = {s: placed.filter(F.col("split") == s).select("key") for s in ("train", "val", "test")}

    def shared(a: str, b: str) -> DataFrame:
        return part[a].join(part[b], "key", "left_semi").agg(F.count(F.lit(1)).alias(f"{a}_{b}"))

    counts = [
        placed.agg(F.count(F.lit(1)).alias("n_rows")),
        shared("train", "val"),
        shared("train", "test"),
        shared("val", "test"),
        ledger(spark, sf)
        .join(placed.select("key"), "key", "left_anti")
        .agg(F.count(F.lit(1)).alias("left_out")),
    ]
    out = counts[0].withColumn("#one", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("#one", F.lit(1)), "#one")
    return out.drop("#one")


RARE = "case when o_orderkey < 2 then 'RARE' when o_orderkey < 5 then 'ENOUGH' else o_orderstatus end"


@query(
    "rare_classes",
    f"select {RARE} label, count(*) count from orders group by 1 having count(*) < 3",
)
def _(spark, sf):
    return classes.rare_classes(table(spark, sf, "orders").selectExpr(f"{RARE} as label"), "label")


@query(
    "rare_classes_of_a_split",
    "select o_custkey::varchar label, count(*) count from orders group by 1 having count(*) < 3",
)
def _(spark, sf):
    """All classes too small for a split, as its error hands them on."""
    try:
        check_classes(table(spark, sf, "orders"), "o_custkey")
    except RareClassesError as refused:
        return refused.classes
    raise AssertionError("classes of one row were accepted")


@query(
    "split_class_distribution",
    f"with {LEDGER_PLACED} select split, status label, count(*) count from placed group by all",
)
def _(spark, sf):
    return classes.split_class_distribution(ledger_placed(spark, sf), "status")


@query(
    "balanced_weights",
    f"with {LEDGER_PLACED}, t as (select * from placed where split = 'train') select key, "
    "round((select count(*) from t) / ((select count(distinct status) from t) * "
    "count(*) over (partition by status))::double, 9) weight from t",
)
def _(spark, sf):
    train = ledger_placed(spark, sf).filter("split = 'train'").select("key", "status")
    weights = classes.balanced_weights(train, "status").select("label", "weight")
    joined = classes.join_classes(
        train, weights, weights.count(), (F.col("status"), "label")
    )
    return joined.select("key", F.round("weight", 9).alias("weight"))


@query(
    "label_encode",
    "select event_type label, (row_number() over (order by event_type) - 1)::int code "
    "from (select distinct event_type from events)",
)
def _(spark, sf):
    return classes.label_codes(table(spark, sf, "events"), "event_type")


@query(
    "feature_selection",
    f"""with {LEDGER_FIT} select ord::int ord, feature,
      case when lo = hi then 'constant' when norm_var < 0.01 then 'low variance' else 'kept' end status
    from train_stats""",
)
def _(spark, sf):
    train = ledger_train(ledger_placed(spark, sf))
    chosen = select_features(train, "status")
    status = {
        **dict.fromkeys(chosen.kept, "kept"),
        **dict.fromkeys(chosen.constant, "constant"),
        **dict.fromkeys(chosen.low_variance, "low variance"),
    }
    rows = [(i, c, status[c]) for i, c in enumerate(column_stats.numeric_columns(train))]
    return spark.createDataFrame(rows, "ord int, feature string, status string")


@query("fit_medians", f'with {LEDGER_FIT} select feature, round("median", 4) as "median" from params')
def _(spark, sf):
    return ledger_fit(ledger_placed(spark, sf)).parameters(spark).select("feature", F.round("median", 4).alias("median"))


@query(
    "fit_scaler",
    f'with {LEDGER_FIT} select feature, round(mean, 4) mean, round("scale", 4) as "scale" from params',
)
def _(spark, sf):
    return ledger_fit(ledger_placed(spark, sf)).parameters(spark).select(
        "feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale")
    )


@query(
    "fit_parameters",
    f"""with {LEDGER_FIT} select ord::int ord, feature, round("median", 4) as "median",
      round(mean, 4) mean, round("scale", 4) as "scale", null::int code, null label from params
    union all select null, null, null, null, null, (row_number() over (order by label) - 1)::int, label
      from (select distinct status label from train)""",
)
def _(spark, sf):
    fitted = ledger_fit(ledger_placed(spark, sf))
    numbers = [F.round(c, 4).alias(c) for c in ("median", "mean", "scale")]
    parameters = fitted.parameters(spark).select("ord", "feature", *numbers)
    return parameters.unionByName(fitted.class_table(spark), allowMissingColumns=True)


def _scaled(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if c in LEDGER_KEPT else F.col(c) for c in df.columns]
    )


@query("transform_features", f"with {LEDGER_FIT} select key, {scaled_sql(LEDGER_KEPT)} from placed")
def _(spark, sf):
    placed = ledger_placed(spark, sf)
    return _scaled(ledger_fit(placed).transform_features(placed, ("key",)))


LABELED = f"""codes as (select status s, (row_number() over (order by status) - 1)::int code
  from (select distinct status from train)),
labeled as (select key, split, {scaled_sql(LEDGER_KEPT)}, code as status
  from placed join codes on placed.status = s)"""


@query("transform_labeled", f"with {LEDGER_FIT}, {LABELED} select * from labeled")
def _(spark, sf):
    placed = ledger_placed(spark, sf)
    return _scaled(ledger_fit(placed).transform(placed, ("key", "split")))


@query("decode_labels", f"with {LEDGER} select key, status as class from ledger")
def _(spark, sf):
    placed = ledger_placed(spark, sf)
    fitted = ledger_fit(placed)
    coded = fitted.transform(placed, ("key",)).select("key", "status")
    return fitted.decode(coded, "status").drop("status")


@query(
    "pipeline_metadata",
    f"""with {LEDGER_FIT} select 'status' label_column,
      (select string_agg(feature, ',' order by ord) from params) feature_columns,
      (select string_agg(feature, ',' order by ord) from train_stats where lo = hi) dropped_constant,
      (select string_agg(feature, ',' order by ord) from train_stats where norm_var < 0.01)
        dropped_low_variance,
      (select string_agg(distinct status, ',' order by status) from train) label_classes,
      (select count(*) from train) n_train_rows""",
)
def _(spark, sf):
    m = ledger_fit(ledger_placed(spark, sf)).metadata()
    row = (
        m["label_column"],
        ",".join(m["feature_columns"]),
        ",".join(m["dropped_constant_columns"]),
        ",".join(m["dropped_low_variance_columns"]),
        ",".join(m["label_classes"]),
        m["n_train_rows"],
    )
    return spark.createDataFrame(
        [row],
        "label_column string, feature_columns string, dropped_constant string, "
        "dropped_low_variance string, label_classes string, n_train_rows long",
    )


@query(
    "pipeline_save_load",
    f"with {LEDGER_FIT} select key, split, {scaled_sql(LEDGER_KEPT)} from placed",
)
def _(spark, sf):
    path, placed = shared_path(spark, "preprocessing"), ledger_placed(spark, sf)
    ledger_fit(placed).save(spark, path)
    return _scaled(FittedPreprocessing.load(spark, path).transform_features(placed, ("key", "split")))


@query("write_read_roundtrip", f"with {LEDGER_PLACED} select * from placed")
def _(spark, sf):
    path = write_splits(ledger_placed(spark, sf), shared_path(spark, "splits"))
    parts = [read_split(spark, path, part).withColumn("split", F.lit(part)) for part in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _run(spark, sf: str) -> PreprocessingRun:
    rows = ledger(spark, sf)
    repeated = rows.union(rows.filter("key % 20 = 0"))
    return preprocess_table(
        repeated,
        shared_path(spark, "processed"),
        shared_path(spark, "artifacts"),
        label="status",
        key="key",
        source="ledger",
    )


@query(
    "preprocess_run_summary",
    f"""with {LEDGER_PLACED}, r as (select count(*) n from ledger where key % 20 = 0)
    select 'ledger' source_path, (select count(*) from ledger) + r.n n_rows_input,
      (select count(*) from ledger) n_rows_after_dedup, r.n n_duplicate_rows_removed,
      (select count(*) from placed where split = 'train') n_train_rows,
      (select count(*) from placed where split = 'val') n_val_rows,
      (select count(*) from placed where split = 'test') n_test_rows,
      0.7::double train_size, 0.15::double val_size, 0.15::double test_size,
      42::bigint random_state from r""",
)
def _(spark, sf):
    s = dict(_run(spark, sf).summary)
    s.pop("label_column")
    return spark.createDataFrame(
        [tuple(s.values())],
        "source_path string, n_rows_input long, n_rows_after_dedup long, "
        "n_duplicate_rows_removed long, n_train_rows long, n_val_rows long, n_test_rows long, "
        "train_size double, val_size double, test_size double, random_state long",
    )


@query(
    "preprocess_end_to_end",
    f"""with {LEDGER_FIT}, {LABELED} select split, status, count(*) n,
      {", ".join(f"round(sum({c}), 3) as {c}" for c in LEDGER_KEPT)} from labeled group by all""",
)
def _(spark, sf):
    processed = spark.read.parquet(_run(spark, sf).paths["processed"])
    return processed.groupBy("split", "status").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(F.round(c, 6)), 3).alias(c) for c in LEDGER_KEPT],
    )


@query(
    "read_processed",
    f"with {LEDGER_FIT}, {LABELED} select * exclude (split) from labeled where split = 'train'",
)
def _(spark, sf):
    run = _run(spark, sf)
    train = read_split(spark, run.paths["processed"], "train")
    contract.require_columns(train, run.fitted.feature_names, "processed data")
    return _scaled(train.select("key", *LEDGER_KEPT, "status"))
