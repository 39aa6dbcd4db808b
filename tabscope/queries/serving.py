"""Queries of scoring: contract checks, predictions, history and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions import text
from tabscope.operators import contract, history, scoring
from tabscope.operators.classes import ordered_labels
from tabscope.plans.scoring import score_requests
from tabscope.plans.uploads import score_upload
from tabscope.queries import query
from tabscope.queries.fixtures import (
    CLASS_NAMES,
    LINEAR,
    REQUEST_FEATURES,
    SCORES,
    request_bundle,
    requests,
    scores,
    table,
    utc,
)
from tabscope.session import shared_path
from tabscope.streaming import jobs

REASONS = """case when event_id % 10 = 0 then 'user_id' else '' end missing,
  case when event_id % 15 = 0 then 'debug' else '' end unexpected,
  event_id % 10 != 0 and event_id % 15 != 0 as valid,
  case when event_id % 10 = 0 and event_id % 15 = 0
      then 'missing features: user_id — unexpected features: debug'
    when event_id % 10 = 0 then 'missing features: user_id'
    when event_id % 15 = 0 then 'unexpected features: debug' end detail"""


@query("validate_feature_contract", f"select event_id, {REASONS} from events")
def _(spark, sf):
    checked = contract.check_features(requests(table(spark, sf, "events")), REQUEST_FEATURES)
    return checked.select(
        "event_id",
        text.name_list(F.col("missing_features")).alias("missing"),
        text.name_list(F.col("unexpected_features")).alias("unexpected"),
        "valid",
        "detail",
    )


@query(
    "validate_batches",
    f"""with c as (select event_id, event_id // 7 batch_id, {REASONS} from events),
    d as (select event_id, batch_id, first_value(detail) over (partition by batch_id
      order by detail is null, event_id) batch_detail from c)
    select *, batch_detail is null batch_valid from d""",
)
def _(spark, sf):
    df = requests(table(spark, sf, "events")).withColumn(
        "batch_id", F.floor(F.col("event_id") / 7).cast("long")
    )
    checked = contract.check_features(df, REQUEST_FEATURES)
    judged = contract.check_batches(checked, "batch_id", "event_id")
    return judged.select("event_id", "batch_id", "batch_detail", "batch_valid")


@query(
    "score_quality_gate",
    f"""with {SCORES}, g as (select key,
      case when key % 23 = 0 then 1.0 + greatest(p0, p1, p2) else greatest(p0, p1, p2) end confidence,
      case when key % 19 = 0 then 'n/a' when key % 29 = 0 then 'inf' else (key % 100)::varchar end as value
      from scores)
    select key, coalesce(confidence between 0 and 1 and isfinite(try_cast(value as double)), false)
      passes from g""",
)
def _(spark, sf):
    k = F.col("key")
    top = F.array_max("p")
    df = scores(spark, sf).select(
        "key",
        F.when(k % 23 == 0, top + 1).otherwise(top).alias("confidence"),
        F.when(k % 19 == 0, "n/a")
        .when(k % 29 == 0, "inf")
        .otherwise((k % 100).cast("string"))
        .alias("value"),
    )
    return contract.quality_gate(df, "confidence", "value").select("key", "passes")


PREDICTED = f"""{SCORES}, predicted as (select key, ['F', 'O', 'P'][yp + 1] predicted_class,
  greatest(p0, p1, p2) confidence, p0, p1, p2 from scores)"""


@query(
    "score_from_probabilities",
    f"""with {PREDICTED} select key, predicted_class, round(confidence, 9) confidence,
      round(p0, 9) p_f, round(p1, 9) p_o, round(p2, 9) p_p, 'v1' model_version from predicted""",
)
def _(spark, sf):
    out = scoring.predictions(scores(spark, sf), "p", CLASS_NAMES, "v1", ("key",))
    each = [
        F.round(F.col("class_probabilities")[c], 9).alias(f"p_{c.lower()}") for c in CLASS_NAMES
    ]
    return out.select(
        "key", "predicted_class", F.round("confidence", 9).alias("confidence"), *each, "model_version"
    )


@query(
    "ranked_probabilities",
    f"""with {SCORES}, long as (select key, unnest([0, 1, 2]) o, unnest(['F', 'O', 'P']) as class,
      unnest([p0, p1, p2]) p from scores)
    select key, (row_number() over (partition by key order by p desc, o))::int as rank, class,
      round(p, 9) probability from long""",
)
def _(spark, sf):
    out = scoring.ranked_probabilities(scores(spark, sf), "p", CLASS_NAMES, ("key",))
    return out.withColumn("probability", F.round("probability", 9))


@query(
    "class_breakdown",
    f"with {PREDICTED} select predicted_class, count(*) count from predicted group by 1",
)
def _(spark, sf):
    return scoring.class_breakdown(scoring.predictions(scores(spark, sf), "p", CLASS_NAMES, "v1"))


@query("score_feature_maps", f"with {LINEAR} select * exclude (ts, confidence), round(confidence, 9) confidence from scored")
def _(spark, sf):
    good, _ = score_requests(
        requests(table(spark, sf, "events")), request_bundle(spark, sf), keep=("event_id",)
    )
    return _shown(good)


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select(
        "event_id",
        "predicted_class",
        F.round("confidence", 9).alias("confidence"),
        "model_version",
    )


@query(
    "prediction_history",
    """select event_id::varchar id, event_type predicted_class, value confidence,
      (epoch_us(ts))::bigint ts_us from events order by ts desc, event_id::varchar desc limit 200""",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", utc("ts"))
    scored = events.select(
        "event_id",
        "ts",
        F.lit("v1").alias("model_version"),
        F.col("event_type").alias("predicted_class"),
        F.col("value").alias("confidence"),
    )
    entries = history.single_entries(scored, "event_id", "ts")
    path = shared_path(spark, "history")
    cut = F.col("id").cast("long") % 2 == 0
    history.append_history(entries.filter(cut), path)
    history.append_history(entries.filter(~cut), path)
    latest = history.latest_history(spark, path)
    return latest.select("id", "predicted_class", "confidence", F.unix_micros("ts").alias("ts_us"))


@query(
    "score_upload",
    f"""with {LINEAR} select 'upload-1' id, count(*) over () count, predicted_class, n from (
      select predicted_class, count(*) n from scored group by 1)
    """.replace("count(*) over () count", "(sum(n) over ())::bigint count"),
)
def _(spark, sf):
    """The valid requests as a CSV upload: checked, scored, stored and recorded."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").filter((e % 10 != 0) & (e % 15 != 0)).select("user_id", "value")
    path = shared_path(spark, "upload")
    rows.write.csv(f"{path}/file", header=True)
    score_upload(spark, f"{path}/file", request_bundle(spark, sf), f"{path}/scored", f"{path}/history", "upload-1")
    entries = history.read_history(spark, f"{path}/history")
    return entries.select("id", "count", F.explode("class_breakdown").alias("predicted_class", "n"))


@query(
    "history_top_classes",
    """with g as (select event_id // 50 id, event_type, count(*) n from events group by all),
    r as (select *, row_number() over (partition by id order by n desc, event_type) k from g)
    select id::varchar id, event_type predicted_class, n, k::int as rank from r where k <= 3""",
)
def _(spark, sf):
    scored = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 50).cast("long").alias("batch"),
        utc("ts").alias("ts"),
        F.lit("v1").alias("model_version"),
        F.col("event_type").alias("predicted_class"),
    )
    return history.top_classes(history.batch_entries(scored, "batch", "ts"))


@query(
    "ordered_labels",
    """with c as (select distinct c_nationkey code, 'NATION_' || c_nationkey label from customer)
    select code, label, (row_number() over (order by code) - 1)::int position from c""",
)
def _(spark, sf):
    nations = table(spark, sf, "customer").select("c_nationkey").distinct()
    mapping = nations.select(
        F.col("c_nationkey").cast("string").alias("code"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("label"),
    )
    # One row per class: at most 25 nations.
    ordered = ordered_labels(mapping)
    place = F.row_number().over(Window.orderBy("code")) - 1
    return ordered.withColumn("position", place.cast("int"))


@query(
    "formatted_numbers",
    """select p_partkey, format('{:,}', (p_retailprice * 1000)::bigint) thousands,
      case when p_size % 7 = 0 then '—' else printf('%.3f', round(p_size / 64.0::double, 3)) end metric,
      case when p_size % 7 = 0 then '—' else printf('%.1f%%', round(p_size * 100 / 64.0::double, 1)) end percent,
      case when p_partkey * 1000 < 1024 then printf('%.2f B', p_partkey * 1000.0::double)
        when p_partkey * 1000 < 1048576 then printf('%.2f KB', p_partkey * 1000 / 1024.0::double)
        when p_partkey * 1000 < 1073741824 then printf('%.2f MB', p_partkey * 1000 / 1048576.0::double)
        else printf('%.2f GB', p_partkey * 1000 / 1073741824.0::double) end size
    from part""",
)
def _(spark, sf):
    share = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 64.0)
    return table(spark, sf, "part").select(
        "p_partkey",
        text.thousands((F.col("p_retailprice") * 1000).cast("long")).alias("thousands"),
        text.metric(share).alias("metric"),
        text.percent(share).alias("percent"),
        text.byte_size(F.col("p_partkey") * 1000).alias("size"),
    )


def _event_stream(spark, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return jobs.stream_table(spark, sf, schema, "events.parquet")


@query("stream_score", f"with {LINEAR} select * exclude (ts, confidence), round(confidence, 9) confidence from scored")
def _(spark, sf):
    bundle, path = request_bundle(spark, sf), shared_path(spark, "stream")
    scored = jobs.scored_stream(requests(_event_stream(spark, sf)), bundle, ("event_id",))
    jobs.append_to(scored, f"{path}/out", f"{path}/checkpoint")
    return _shown(spark.read.parquet(f"{path}/out"))


@query(
    "stream_reject",
    f"""with {LINEAR}, r as (select event_id, {REASONS} from events)
    select event_id, 'rejected' outcome, missing, unexpected, detail, null predicted_class
      from r where not valid
    union all select event_id, 'accepted', null, null, null, predicted_class from scored""",
)
def _(spark, sf):
    bundle, path = request_bundle(spark, sf), shared_path(spark, "stream")
    writer = jobs.route_requests(
        requests(_event_stream(spark, sf)), bundle, f"{path}/good", f"{path}/bad", ("event_id",)
    )
    jobs.run_available(writer, f"{path}/checkpoint")
    bad = spark.read.parquet(f"{path}/bad").select(
        "event_id",
        F.lit("rejected").alias("outcome"),
        text.name_list(F.col("missing_features")).alias("missing"),
        text.name_list(F.col("unexpected_features")).alias("unexpected"),
        "detail",
    )
    good = spark.read.parquet(f"{path}/good").select(
        "event_id", F.lit("accepted").alias("outcome"), "predicted_class"
    )
    return bad.unionByName(good, allowMissingColumns=True)


@query(
    "stream_class_breakdown",
    """select epoch(ts::date)::bigint window_start, event_type predicted_class, count(*) count
    from events group by all""",
)
def _(spark, sf):
    path = shared_path(spark, "stream")
    timed = _event_stream(spark, sf).select(utc("ts").alias("ts"), "event_type")
    counts = jobs.windowed_breakdown(timed, class_column="event_type")
    jobs.update_table(counts, f"{path}/out", f"{path}/checkpoint")
    return jobs.current_rows(spark, f"{path}/out", ["window_start", "predicted_class"]).select(
        F.unix_seconds("window_start").alias("window_start"), "predicted_class", "count"
    )


@query("stream_dedup", "select event_id, user_id, event_type, value from events")
def _(spark, sf):
    path = shared_path(spark, "stream")
    e = F.col("event_id")
    # Every fourth event arrives twice.
    arrivals = _event_stream(spark, sf).select(
        "event_id", "user_id", "event_type", "value", utc("ts").alias("ts"),
        F.explode(F.when(e % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    once = jobs.without_repeats(arrivals.drop("col"), ["event_id"])
    jobs.append_to(once, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").drop("ts")
