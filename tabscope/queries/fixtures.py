"""Views on the test tables that show the anomalies of real flow captures.

Each view has a Spark and a SQL form with the same arithmetic.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.probability import argmax, softmax
from tabscope.operators.preprocess import FittedPreprocessing, fit
from tabscope.operators.split import stratified_split
from tabscope.plans.scoring import Bundle
from tabscope.plans.trainers import FEATURES, PROBABILITY
from tabscope.session import stage_table

INF = float("inf")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- flows: duplicates, infinities, gaps, a constant and a near-constant column ---

FLOW_NUMBERS = (
    "dst_port", "duration", "pkts", "subflow_pkts", "bytes_per_s", "pkt_len_max", "urg_flags",
    "psh_flags",
)


def flows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    tax, line, order = F.col("l_tax"), F.col("l_linenumber"), F.col("l_orderkey")
    base = li.select(
        F.col("l_partkey").alias("dst_port"),
        F.when(tax == 0, 0.0).otherwise(F.col("l_quantity")).alias("duration"),
        F.col("l_quantity").alias("pkts"),
        (F.col("l_quantity") + line.cast("double") / 1000.0).alias("subflow_pkts"),
        F.when((tax == 0) & (line == 1), None)
        .when(tax == 0, F.lit(INF))
        .otherwise(F.try_divide("l_extendedprice", tax))
        .alias("bytes_per_s"),
        F.when(line != 7, F.col("l_extendedprice")).alias("pkt_len_max"),
        F.lit(0.0).alias("urg_flags"),
        F.when(order % 200 == 0, 100.0).otherwise(3.0).alias("psh_flags"),
        F.when(order % 97 == 0, "PortScan")
        .when(order % 7 == 0, "DDoS")
        .otherwise("BENIGN")
        .alias("label"),
        # Every twentieth order appears twice.
        F.explode(F.when(order % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return base.drop("col")


FLOWS = """b as (
  select l_partkey dst_port,
    case when l_tax=0 then 0.0::double else l_quantity end duration,
    l_quantity pkts,
    l_quantity + l_linenumber::double / 1000.0::double subflow_pkts,
    case when l_tax=0 and l_linenumber=1 then null
         when l_tax=0 then 'Infinity'::double
         else l_extendedprice/l_tax end bytes_per_s,
    case when l_linenumber=7 then null else l_extendedprice end pkt_len_max,
    0.0::double urg_flags,
    case when l_orderkey % 200 = 0 then 100.0::double else 3.0::double end psh_flags,
    case when l_orderkey % 97 = 0 then 'PortScan' when l_orderkey % 7 = 0 then 'DDoS'
         else 'BENIGN' end label,
    l_orderkey
  from lineitem),
flows as (
  select * exclude (l_orderkey) from b
  union all select * exclude (l_orderkey) from b where l_orderkey % 20 = 0)"""

FLOW_LONG = "flow_long as (" + " union all ".join(
    f"select {i} ord, '{c}' col, {c}::double v from flows" for i, c in enumerate(FLOW_NUMBERS)
) + ")"

# Per column counts, moments and the normalised variance, from the long form.
FLOW_COLUMNS = f"""{FLOWS}, {FLOW_LONG},
fin as (select ord, col, v, case when isinf(v) then null else v end f from flow_long),
rng as (select ord, col, min(f) lo, max(f) hi from fin group by all),
cols as (
  select fin.ord, fin.col, count(*) n_rows, count(*) - count(v) n_missing,
    count(*) filter (isinf(v)) n_inf, count(v) n_known, any_value(lo) lo, any_value(hi) hi,
    avg(f) fin_mean, case when any_value(hi) > any_value(lo)
      then var_samp((f - lo) / (hi - lo)) end norm_var
  from fin join rng using (ord, col) group by all)"""


def flow_pairs_sql() -> str:
    """r of each numeric pair over the rows where both are finite."""
    parts = []
    k = len(FLOW_NUMBERS)
    for i in range(k):
        for j in range(i + 1, k):
            a, b = FLOW_NUMBERS[i], FLOW_NUMBERS[j]
            parts.append(
                f"select {i} ord_a, {j} ord_b, '{a}' feature_a, '{b}' feature_b, "
                f"case when isnan(r) then null else r end r from "
                f"(select corr({a}::double, {b}::double) r from flows where "
                f"{a} is not null and {b} is not null and not isinf({a}::double) "
                f"and not isinf({b}::double))"
            )
    return "pairs as (" + " union all ".join(parts) + ")"


# --- ledger: one row per order with a unique key, for splits and fits ---

LEDGER_NUMBERS = ("cust", "price", "rate", "month", "flat", "spike")
LEDGER_KEPT = ("cust", "price", "rate", "month")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("key"),
        F.col("o_custkey").alias("cust"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 13 == 0, F.lit(INF))
        .when(k % 17 != 0, F.col("o_totalprice") / (1 + k % 5))
        .alias("rate"),
        F.month("o_orderdate").alias("month"),
        F.lit(0.0).alias("flat"),
        F.when(k % 200 == 0, 100.0).otherwise(3.0).alias("spike"),
        F.col("o_orderstatus").alias("status"),
    )


LEDGER = """ledger as (
  select o_orderkey as key, o_custkey cust,
    case when o_orderkey % 11 != 0 then o_totalprice end price,
    case when o_orderkey % 13 = 0 then 'Infinity'::double
         when o_orderkey % 17 != 0 then o_totalprice / (1 + o_orderkey % 5)::double end rate,
    month(o_orderdate)::int as month, 0.0::double flat,
    case when o_orderkey % 200 = 0 then 100.0::double else 3.0::double end spike,
    o_orderstatus status
  from orders)"""


def split_sql(source: str, label: str, key: str, prefix: str = "") -> str:
    """CTEs ``alloc`` and ``placed``: the split by whole-class windows."""
    take = """
    {p}x{i} as (select *, {draw} as draw, {size}::double / sum({size}) over ()::double
             * ({draw})::double as exact from {src}),
    {p}y{i} as (select *, floor(exact)::bigint as whole, exact - floor(exact) as rest from {p}x{i}),
    {p}z{i} as (select * exclude (draw, exact, whole, rest),
       (whole + case when rest > 0 and row_number() over (order by rest desc, label)
        <= draw - sum(whole) over () then 1 else 0 end)::bigint as {out} from {p}y{i})"""
    one = take.format(
        p=prefix, i=1, size="c", out="kept", src=f"{prefix}counts",
        draw="(sum(c) over () - ceil(0.15::double * sum(c) over ()::double))::bigint",
    )
    two = take.format(
        p=prefix, i=2, size="kept", out="n_train", src=f"{prefix}z1",
        draw="(sum(kept) over () - ceil(0.15::double / (0.7::double + 0.15::double)"
        " * sum(kept) over ()::double))::bigint",
    )
    return f"""{prefix}counts as (select {label} as label, count(*) as c from {source} group by 1),
    {one}, {two},
    {prefix}alloc as (select label, c as n, n_train, kept - n_train as n_val, c - kept as n_test
      from {prefix}z2),
    {prefix}placed as (select s.*, case
        when row_number() over (partition by {label} order by md5('42|' || {key})) <= n_test
          then 'test'
        when row_number() over (partition by {label} order by md5('42|' || {key})) <= n_test + n_val
          then 'val' else 'train' end as split
      from {source} s join {prefix}alloc a on s.{label} = a.label)"""  # fmt: skip


LEDGER_PLACED = f"{LEDGER}, {split_sql('ledger', 'status', 'key')}"

LEDGER_FIT = (
    LEDGER_PLACED
    + ", train as (select * from placed where split = 'train'), train_long as ("
    + " union all ".join(
        f"select {i} ord, '{c}' feature, case when isinf({c}::double) then null "
        f"else {c}::double end v from train"
        for i, c in enumerate(LEDGER_NUMBERS)
    )
    + """), train_rng as (
  select ord, feature, min(v) lo, max(v) hi, quantile_cont(v, 0.5) med from train_long group by all),
train_stats as (
  select t.ord, t.feature, any_value(med) as "median", any_value(lo) lo, any_value(hi) hi,
    count(*) n, count(v) n_finite,
    case when any_value(hi) > any_value(lo) then var_samp((v - lo) / (hi - lo)) end norm_var,
    avg(coalesce(v, med)) mean, stddev_pop(coalesce(v, med)) dev
  from train_long t join train_rng using (ord, feature) group by all),
params as (
  select row_number() over (order by ord) - 1 as ord, feature, "median", mean,
    case when dev = 0 then 1.0 else dev end as "scale"
  from train_stats where hi > lo and norm_var >= 0.01)"""
)


def scaled_sql(columns: tuple[str, ...], digits: int = 6) -> str:
    """Scaled and rounded select items by the ``params`` CTE."""

    def fitted(name: str, c: str) -> str:
        return f"(select {name} from params where feature = '{c}')"

    out = []
    for c in columns:
        value = f"case when isinf({c}::double) then null else {c}::double end"
        med, mean, scale = (fitted(n, c) for n in ('"median"', "mean", '"scale"'))
        out.append(f"round((coalesce({value}, {med}) - {mean}) / {scale}, {digits}) as {c}")
    return ", ".join(out)


def ledger_placed(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with its split, stored once for the query that asks."""
    return stage_table(
        stratified_split(ledger(spark, sf), "status", key="key"), "ledger", partition_by=["split"]
    )


def ledger_train(placed: DataFrame) -> DataFrame:
    return placed.filter("split = 'train'").drop("split", "key")


def ledger_fit(placed: DataFrame) -> FittedPreprocessing:
    return fit(ledger_train(placed), "status")


# --- scores: true and predicted codes with many tied probabilities ---

CLASS_NAMES = ["F", "O", "P"]
CODES = [0, 1, 2]


def scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    raw = [
        1.0 + 2.0 * F.when(F.col("y") == i, 1.0).otherwise(0.0) + (F.col("key") * m % 11) * F.lit(0.4)
        for i, m in enumerate((3, 5, 7))
    ]
    base = table(spark, sf, "orders").select(k.alias("key"), y.alias("y"))
    summed = base.select("key", "y", *[r.alias(f"r{i}") for i, r in enumerate(raw)])
    total = F.col("r0") + F.col("r1") + F.col("r2")
    p = F.array(*[F.col(f"r{i}") / total for i in range(3)])
    return summed.select("key", "y", p.alias("p")).select("key", "y", argmax(F.col("p")).alias("yp"), "p")


SCORES = """raw as (
  select o_orderkey as key, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end y from orders),
rr as (select key, y,
    1.0::double + 2.0::double * (y = 0)::int + (key * 3 % 11) * 0.4::double r0,
    1.0::double + 2.0::double * (y = 1)::int + (key * 5 % 11) * 0.4::double r1,
    1.0::double + 2.0::double * (y = 2)::int + (key * 7 % 11) * 0.4::double r2 from raw),
pp as (select key, y, r0 / (r0 + r1 + r2) p0, r1 / (r0 + r1 + r2) p1, r2 / (r0 + r1 + r2) p2 from rr),
scores as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end yp from pp)"""


# --- requests: feature maps of events, some with a key too few or too many ---

REQUEST_FEATURES = ["user_id", "value"]


def requests(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    entries = [
        F.when(e % 10 != 0, F.struct(F.lit("user_id").alias("k"), F.col("user_id").cast("double").alias("v"))),
        F.struct(F.lit("value").alias("k"), F.col("value").alias("v")),
        F.when(e % 15 == 0, F.struct(F.lit("debug").alias("k"), F.lit(1.0).alias("v"))),
    ]
    kept = F.filter(F.array(*entries), lambda s: s.isNotNull())
    return events.withColumn("features", F.map_from_entries(kept))


def utc(ts: str) -> Column:
    """A zone-less time taken as UTC, whatever the session's zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', " + ts + ")")
    return F.timestamp_micros(micros)


class LinearScorer:
    """A fixed linear model: class i scores (0.5i - 0.7) x0 + (0.2 - 0.3i) x1 + 0.05i."""

    def __init__(self, n_classes: int):
        self.n_classes = n_classes

    def probabilities(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(FEATURES)
        s = [
            F.get(x, F.lit(0)) * (0.5 * i - 0.7) + F.get(x, F.lit(1)) * (0.2 - 0.3 * i) + 0.05 * i
            for i in range(self.n_classes)
        ]
        return df.select(*df.columns, softmax(s).alias(PROBABILITY))


def request_bundle(spark: SparkSession, sf: str) -> Bundle:
    events = table(spark, sf, "events").select("user_id", "value", "event_type")
    # The fixed model scores both features, however little one of them varies beside an outlier.
    fitted = fit(events, "event_type", low_variance=0.0)
    return Bundle(fitted, LinearScorer(len(fitted.classes)), {"version": "v1", "model_type": "linear"})


EVENT_CLASSES = 5
LINEAR = f"""ev as (
  select *, avg(user_id::double) over () m0, stddev_pop(user_id::double) over () s0,
    avg(value) over () m1, stddev_pop(value) over () s1 from events),
names as (select list(distinct event_type order by event_type) names from events),
zz as (select * exclude (m0, s0, m1, s1), (user_id - m0) / s0 x0, (value - m1) / s1 x1 from ev
       where event_id % 10 != 0 and event_id % 15 != 0),
lin as (select *, [{", ".join(
    f"x0 * {0.5 * i - 0.7!r}::double + x1 * {0.2 - 0.3 * i!r}::double + {0.05 * i!r}::double"
    for i in range(EVENT_CLASSES))}] s from zz),
scored as (select event_id, ts, names[list_position(s, list_max(s))] predicted_class,
    1.0 / list_sum(list_transform(s, lambda e: exp(e - list_max(s)))) confidence, 'v1' model_version
  from lin, names)"""
