"""Queries of the profile: columns, correlations, classes, charts, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.functions import text
from tabscope.operators import charts, classes, column_stats, correlation, duplicates, summary
from tabscope.plans import findings
from tabscope.plans.profile import Profile, build_profile, profile_record, profile_rows
from tabscope.queries import query
from tabscope.queries.fixtures import (
    FLOW_COLUMNS,
    FLOW_LONG,
    FLOW_NUMBERS,
    FLOWS,
    flow_pairs_sql,
    flows,
    table,
)
from tabscope.sources.tables import read_record, write_record
from tabscope.session import shared_path

COLS, PAIRS = FLOW_COLUMNS, flow_pairs_sql()
PCT = "round(({}) * 100.0::double / ({}), 4)"
CLASSES = f"""dist as (select label, count(*) count,
  {PCT.format("count(*)::double", "sum(count(*)) over ()")} pct from flows group by label)"""
DUPLICATES = f"""dup as (select (sum(n) - count(*))::bigint duplicate_rows,
  {PCT.format("(sum(n) - count(*))::double", "sum(n)")} duplicate_pct from
  (select {", ".join(FLOW_NUMBERS)}, label, count(*) n from flows group by all))"""


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return column_stats.column_profile(flows(spark, sf))


@query("select_numeric", f"with {FLOWS} select {', '.join(FLOW_NUMBERS)} from flows")
def _(spark, sf):
    return column_stats.select_numeric(flows(spark, sf))


@query(
    "replace_infinite",
    f"with {FLOWS} select * replace (case when isinf(bytes_per_s) then null else bytes_per_s end "
    "as bytes_per_s) from flows",
)
def _(spark, sf):
    return column_stats.replace_infinite(flows(spark, sf))


@query("profile_shape", f"with {FLOWS} select count(*) n_rows, 9::bigint n_cols from flows")
def _(spark, sf):
    return column_stats.table_shape(flows(spark, sf))


@query(
    "profile_missing",
    f"with {COLS} select col as column, n_missing as count, "
    f"{PCT.format('n_missing::double', 'n_rows')} as pct from cols where n_missing > 0",
)
def _(spark, sf):
    return column_stats.missing_values(columns(spark, sf)).drop("ord")


@query("profile_infinite", f"with {COLS} select col as column, n_inf as count from cols where n_inf > 0")
def _(spark, sf):
    return column_stats.infinite_values(columns(spark, sf)).drop("ord")


@query("profile_duplicates", f"with {FLOWS}, {DUPLICATES} select * from dup")
def _(spark, sf):
    return duplicates.duplicate_rows(flows(spark, sf))


@query("drop_duplicates", f"with {FLOWS} select distinct * from flows")
def _(spark, sf):
    return duplicates.drop_duplicate_rows(flows(spark, sf))


@query("class_distribution", f"with {FLOWS}, {CLASSES} select * from dist")
def _(spark, sf):
    return classes.class_distribution(flows(spark, sf), "label")


@query(
    "class_distribution_missing_label",
    f"""with g as (select case when o_orderkey % 9 = 0 then 'nan' else o_orderpriority end label
      from orders)
    select label, count(*) count, {PCT.format("count(*)::double", "sum(count(*)) over ()")} pct
    from g group by label""",
)
def _(spark, sf):
    gaps = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("label")
    )
    return classes.class_distribution(gaps, "label")


@query(
    "class_imbalance",
    f"""with {FLOWS}, {CLASSES} select (select count(*) from dist) n_classes, a.label majority,
      a.count majority_count, b.label minority, b.count minority_count,
      round(a.count::double / b.count, 6) ratio
    from (select * from dist order by count desc, label limit 1) a,
      (select * from dist order by count, label desc limit 1) b""",
)
def _(spark, sf):
    out = classes.class_imbalance(classes.class_distribution(flows(spark, sf), "label"))
    return out.withColumn("ratio", F.round("ratio", 6))


SUMMARY = """stats as (select ord, col, count(v) n, avg(v) mean,
    case when count(*) filter (isinf(v)) > 0 then null else stddev_samp(f) end std,
    min(v) lo, quantile_cont(v, 0.25) p25, quantile_cont(v, 0.5) p50, quantile_cont(v, 0.75) p75,
    max(v) hi from fin group by ord, col)"""


@query(
    "summary_statistics",
    f"""with {COLS}, {SUMMARY} select col as column, n as count, round(mean, 3) mean,
      round(std, 3) std, round(lo, 3) as min, round(p25, 3) p25, round(p50, 3) p50,
      round(p75, 3) p75, round(hi, 3) as max from stats""",
)
def _(spark, sf):
    stats = summary.summary_statistics(flows(spark, sf))
    renamed = stats.withColumnsRenamed({"25%": "p25", "50%": "p50", "75%": "p75"})
    rounded = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return renamed.select("column", "count", *[F.round(c, 3).alias(c) for c in rounded])


def _wide_sql() -> str:
    stats = (
        ("count", "n::double"), ("mean", "mean"), ("std", "std"), ("min", "lo"), ("25%", "p25"),
        ("50%", "p50"), ("75%", "p75"), ("max", "hi"),
    )
    rows = [
        f"select '{name}' as statistic, "
        + ", ".join(
            f"round(max({e}) filter (where col = '{c}'), 3) as {c}" for c in FLOW_NUMBERS
        )
        + " from stats"
        for name, e in stats
    ]
    return f"with {COLS}, {SUMMARY} " + " union all ".join(rows)


@query("summary_statistics_wide", _wide_sql())
def _(spark, sf):
    wide = summary.summary_wide(summary.summary_statistics(flows(spark, sf)), list(FLOW_NUMBERS))
    return wide.select("statistic", *[F.round(c, 3).alias(c) for c in FLOW_NUMBERS])


@query("constant_columns", f"with {COLS} select col as column from cols where n_missing = n_rows or (n_missing = 0 and n_inf = 0 and lo = hi)")
def _(spark, sf):
    return column_stats.constant_columns(columns(spark, sf)).drop("ord")


@query(
    "low_variance_columns",
    f"with {COLS} select col as column, round(norm_var, 6) variance from cols where norm_var < 0.01",
)
def _(spark, sf):
    return column_stats.low_variance_columns(columns(spark, sf)).drop("ord")


@query(
    "normalized_variance",
    f"with {COLS} select col as column, round(norm_var, 9) norm_var from cols where norm_var is not null",
)
def _(spark, sf):
    out = column_stats.normalized_variance(columns(spark, sf)).drop("ord")
    return out.withColumn("norm_var", F.round("norm_var", 9))


@query(
    "top_variance_features",
    f"""with {COLS} select col as column, row_number() over (order by norm_var desc, ord) as rank
    from cols where norm_var is not null order by norm_var desc, ord limit 9""",
)
def _(spark, sf):
    top = column_stats.top_variance(columns(spark, sf))
    ranked = Window.orderBy(F.desc("norm_var"), "ord")
    return top.select("column", F.row_number().over(ranked).cast("long").alias("rank"))


@query(
    "worst_missing",
    f"""with {COLS} select col as column, n_missing as count,
      {PCT.format('n_missing::double', 'n_rows')} as pct
    from cols where n_missing > 0 order by n_missing desc, ord limit 5""",
)
def _(spark, sf):
    return column_stats.worst_missing(columns(spark, sf)).drop("ord")


@query(
    "profile_size_estimate",
    f"""with {FLOWS} select (count(*) * 8 * {len(FLOW_NUMBERS)} + sum(octet_length(encode(label))))::bigint
      size_bytes from flows""",
)
def _(spark, sf):
    return column_stats.size_estimate(columns(spark, sf))


@query(
    "profile_dtypes",
    f"""with {FLOWS}, types as (select {", ".join(
        f"typeof(any_value({c})) as {c}" for c in (*FLOW_NUMBERS, "label"))} from flows),
    long as (unpivot types on columns(*) into name column_name value t)
    select column_name as column, case t when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double'
      else 'string' end dtype from long""",
)
def _(spark, sf):
    return column_stats.column_types(flows(spark, sf)).drop("ord")


@query(
    "correlated_pairs",
    f"""with {FLOWS}, {PAIRS} select feature_a, feature_b, round(r, 4) correlation
    from pairs where abs(r) >= 0.95""",
)
def _(spark, sf):
    pairs = correlation.correlations(flows(spark, sf))
    return correlation.correlated_pairs(pairs).drop("ord_a", "ord_b")


MATRIX = f"""with {FLOWS}, {FLOW_LONG}, {PAIRS},
diag as (select col, min(v) lo, max(v) hi from flow_long where not isinf(v) group by col)
select feature_a, feature_b, round(r, 6) r from pairs
union all select feature_b, feature_a, round(r, 6) from pairs
union all select col, col, case when hi > lo then 1.0::double end from diag"""


def _matrix(spark, sf) -> DataFrame:
    df = flows(spark, sf)
    profile = column_stats.column_profile(df)
    names = correlation.heatmap_columns(df, profile)
    pairs = correlation.correlations(df, names)
    matrix = correlation.correlation_matrix(pairs, profile, names)
    return matrix.withColumn("r", F.round("r", 6))


@query("correlation_matrix", MATRIX)
def _(spark, sf):
    return _matrix(spark, sf)


@query("correlation_matrix_products", MATRIX)
def _(spark, sf):
    """The same over a table dealt to many more tasks, whose moments are merged in two steps."""
    df = flows(spark, sf).repartition(36)
    profile = column_stats.column_profile(df)
    names = correlation.heatmap_columns(df, profile)
    matrix = correlation.correlation_matrix(correlation.correlations(df, names), profile, names)
    return matrix.withColumn("r", F.round("r", 6))


# Six columns; far and near live on different rows of gap, and far is huge where near is missing.
GAPS = """gaps as (select l_orderkey % 97 + l_linenumber * 0.5 as near,
  case when l_orderkey % 3 = 0 then 1e6 + l_partkey % 7 else 1 + 0.01 * (l_orderkey % 97 + l_linenumber * 0.5) end as far,
  l_quantity as q, l_extendedprice as price, l_discount as disc, l_tax as tax,
  l_orderkey % 3 = 0 as gap from lineitem)"""


@query(
    "correlations_with_gaps",
    f"""with {GAPS}, wide as (select case when gap then null else near end near, far, q, price, disc, tax from gaps)
    select a feature_a, b feature_b, round(r, 6) r from (
    {" union all ".join(f"select '{a}' a, '{b}' b, corr({a}, {b}) r from wide where {a} is not null and {b} is not null"
      for i, a in enumerate(("near", "far", "q", "price", "disc", "tax"))
      for b in ("near", "far", "q", "price", "disc", "tax")[i + 1:])})""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    step = F.col("l_orderkey") % 97 + F.col("l_linenumber") * 0.5
    gap = F.col("l_orderkey") % 3 == 0
    wide = li.select(
        F.when(~gap, step).alias("near"),
        F.when(gap, F.lit(1e6) + F.col("l_partkey") % 7).otherwise(1 + 0.01 * step).alias("far"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
    )
    return correlation.correlations(wide).select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@query(
    "numeric_histograms",
    f"""with {COLS}, used as (select * from cols where norm_var is not null
      order by norm_var desc, ord limit 9),
    hits as (select u.col, least(floor((f - u.lo) * 50 / (u.hi - u.lo)), 49)::int bin, count(*) n
      from fin join used u using (col) where f is not null group by all),
    grid as (select col, unnest(range(50))::int bin, lo, hi from used)
    select g.col as column, g.bin, round(lo + g.bin * ((hi - lo) / 50), 4) low,
      coalesce(n, 0) as count from grid g left join hits h on g.col = h.col and g.bin = h.bin""",
)
def _(spark, sf):
    df = flows(spark, sf)
    out = charts.histograms(df, column_stats.column_profile(df))
    return out.select("column", "bin", F.round("low", 4).alias("low"), "count")


@query(
    "missing_matrix_sample",
    """with g as (select o_orderkey as key,
      case when o_orderkey % 7 != 0 then o_totalprice end price,
      case when o_orderkey % 5 != 0 then o_orderpriority end priority from orders)
    select key, price is null as price, priority is null as priority from g
    order by md5('42|' || key) limit 2000""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    gaps = table(spark, sf, "orders").select(
        k.alias("key"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    return charts.missing_matrix(gaps, "key")


def profile(spark: SparkSession, sf: str) -> Profile:
    return build_profile(flows(spark, sf), "label")


FACTS = f"""{COLS}, {PAIRS}, {CLASSES}, {DUPLICATES},
miss as (select ord, col, n_missing n, {PCT.format('n_missing::double', 'n_rows')} pct
  from cols where n_missing > 0),
inf as (select ord, col, n_inf n from cols where n_inf > 0),
cst as (select ord, col from cols where n_missing = n_rows or (n_missing = 0 and n_inf = 0 and lo = hi)),
low as (select ord, col, round(norm_var, 6) variance from cols where norm_var < 0.01),
cor as (select *, round(r, 4) rr from pairs where abs(r) >= 0.95),
maj as (select * from dist order by count desc, label limit 1),
mnr as (select * from dist order by count, label desc limit 1),
tot as (select any_value(n_rows) n_rows from cols)"""


def _heading(ord_: int, finding: str, source: str) -> str:
    return (
        f"select {ord_} ord, '{finding}' finding, 0 item, case when count(*) = 0 then 'none observed'"
        f" else 'total' end subject, count(*) count, null::double as value from {source}"
    )


FINDINGS_SQL = f"""with {FACTS}
{_heading(1, "missing", "miss")}
union all select * from (select 1, 'missing', row_number() over (order by n desc, ord)::int i, col, n, pct
  from miss) where i <= 5
union all {_heading(2, "infinite", "inf")}
union all select 2, 'infinite', row_number() over (order by n desc, ord)::int, col, n, null from inf
union all select 3, 'duplicate', 0, 'total', duplicate_rows, duplicate_pct from dup
union all {_heading(4, "constant", "cst")}
union all select 4, 'constant', row_number() over (order by ord)::int, col, null, null from cst
union all {_heading(5, "low_variance", "low")}
union all select 5, 'low_variance', row_number() over (order by ord)::int, col, null, variance from low
union all {_heading(6, "correlated", "cor")}
union all select * from (select 6, 'correlated',
  row_number() over (order by abs(rr) desc, ord_a, ord_b)::int i,
  feature_a || ' <-> ' || feature_b, null::bigint, rr from cor) where i <= 5
union all select 7, 'imbalance', 0, 'total', (select count(*) from dist),
  round(maj.count::double / mnr.count, 1) from maj, mnr
union all select 7, 'imbalance', 1, label, count, null from maj
union all select 7, 'imbalance', 2, label, count, null from mnr"""


@query("quality_findings", FINDINGS_SQL)
def quality(spark, sf):
    return findings.quality_findings(profile(spark, sf))


@query(
    "recommended_steps",
    f"""with {FACTS}, rules as (
      select 1 o, 'drop constant columns' action, count(*) n from cst
      union all select 2, 'make infinite values missing, then impute', count(*) from inf
      union all select 3, 'impute or drop missing values', count(*) from miss
      union all select 4, 'remove duplicate rows before splitting', duplicate_rows from dup
      union all select 5, 'review low-variance columns', count(*) from low
      union all select 6, 'reduce correlated columns', count(*) from cor
      union all select 7, 'encode the label and scale the features', null
      union all select 8, 'address class imbalance', case when count(*) > 1 then count(*) else 0 end
        from dist)
    select row_number() over (order by o)::int step, action, n affected from rules
    where n is null or n > 0""",
)
def _(spark, sf):
    return findings.recommended_steps(profile(spark, sf))


@query(
    "modelling_challenges",
    f"""with {FACTS}, rules as (
      select 1 o, 'class imbalance' challenge, round(maj.count::double / mnr.count, 1) as value,
        (select count(*) from dist) > 1 due from maj, mnr
      union all select 2, 'multicollinearity', count(*), count(*) > 0 from cor
      union all select 3, 'columns against rows', n_rows, true from tot
      union all select 4, 'infinite and missing values',
        (select count(*) from inf) + (select count(*) from miss),
        (select count(*) from inf) + (select count(*) from miss) > 0
      union all select 5, 'transfer beyond the capture window', null, true)
    select row_number() over (order by o)::int ord, challenge, value::double as value
    from rules where due""",
)
def _(spark, sf):
    return findings.modelling_challenges(profile(spark, sf))


def _profile_full_sql() -> str:
    stats = (
        ("count", "n::double"), ("mean", "mean"), ("std", "std"), ("min", "lo"), ("25%", "p25"),
        ("50%", "p50"), ("75%", "p75"), ("max", "hi"),
    )
    parts = [
        "select 'table' section, '' subject, 'rows' statistic, n_rows::double as value from tot",
        "select 'table', '', 'columns', 9",
        f"select 'table', '', 'size_bytes', count(*) * 8 * {len(FLOW_NUMBERS)} "
        "+ sum(octet_length(encode(label))) from flows",
        "select 'missing', col, 'count', n from miss",
        "select 'missing', col, 'pct', pct from miss",
        "select 'infinite', col, 'count', n from inf",
        "select 'duplicates', '', 'rows', duplicate_rows from dup",
        "select 'duplicates', '', 'pct', duplicate_pct from dup",
        "select 'constant', col, 'flag', 1 from cst",
        "select 'low_variance', col, 'variance', variance from low",
        "select 'correlated', feature_a || ' <-> ' || feature_b, 'r', rr from cor",
        "select 'classes', label, 'count', count from dist",
        "select 'classes', label, 'pct', pct from dist",
        *[f"select 'summary', col, '{n}', round({e}, 3) from stats" for n, e in stats],
    ]
    return f"with {FACTS}, {SUMMARY} " + " union all ".join(parts)


@query("profile_full", _profile_full_sql())
def _(spark, sf):
    rows = profile_rows(profile(spark, sf))
    coarse = F.when(F.col("section") == "summary", F.round("value", 3)).otherwise(F.col("value"))
    return rows.withColumn("value", coarse)


@query(
    "profile_json",
    f"""with {FACTS} select n_rows, 9::bigint n_cols, duplicate_rows, duplicate_pct,
      (select string_agg(col, ',' order by ord) from cst) constant_columns,
      (select string_agg(col, ',' order by ord) from low) low_variance_columns,
      (select string_agg(col || '=' || n, ',' order by ord) from miss) missing,
      (select count(*) from cor) n_pairs,
      (select string_agg(label || '=' || count, ',' order by count desc, label) from dist) classes,
      true as std_of_infinite_is_null
    from tot, dup""",
)
def _(spark, sf):
    path = shared_path(spark, "profile")
    write_record(spark, profile_record(profile(spark, sf)), path)
    d = read_record(spark, path)
    row = (
        d["n_rows"],
        d["n_cols"],
        d["duplicate_row_count"],
        d["duplicate_row_pct"],
        ",".join(d["constant_columns"]),
        ",".join(d["low_variance_columns"]),
        ",".join(f"{k}={v['count']}" for k, v in d["missing_values"].items()),
        len(d["highly_correlated_pairs"]),
        ",".join(f"{k}={v['count']}" for k, v in d["class_distribution"].items()),
        d["summary_statistics"]["bytes_per_s"]["std"] is None,
    )
    return spark.createDataFrame(
        [row],
        "n_rows long, n_cols long, duplicate_rows long, duplicate_pct double, "
        "constant_columns string, low_variance_columns string, missing string, n_pairs long, "
        "classes string, std_of_infinite_is_null boolean",
    )


@query(
    "heatmap_top_columns",
    """with long as (select unnest(range(64))::int ord, unnest(embedding)::double v from embeddings),
    r as (select ord, row_number() over (order by var_samp(v) desc, ord) place from long group by ord)
    select 'e' || ord as feature from r where place <= 60""",
)
def _(spark, sf):
    """The 60 columns of largest variance among the 64 of the embeddings."""
    df = table(spark, sf, "embeddings").select(
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)]
    )
    names = correlation.heatmap_columns(df, column_stats.column_profile(df))
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(
    "chart_titles",
    """select s.name as name, array_to_string(list_transform(string_split(replace(s.name, '_', ' '), ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') as title
    from (select distinct lower(event_type) || '_count_matrix' as name from events) s""",
)
def _(spark, sf):
    kinds = table(spark, sf, "events").select(F.concat(F.lower("event_type"), F.lit("_count_matrix")).alias("name")).distinct()
    return kinds.select("name", text.title(F.col("name")).alias("title"))


@query(
    "profile_job_pairs",
    f"""with {FLOWS}, {PAIRS} select feature_a, feature_b, round(r, 4) correlation from pairs where abs(r) >= 0.95""",
)
def _(spark, sf):
    """The pairs that the profile job has written as CSV."""
    written = findings.profile_job(flows(spark, sf), shared_path(spark, "profile-job"), label="label", key="dst_port")
    return spark.read.csv(written["pairs_csv"], header=True, schema="feature_a string, feature_b string, correlation double")


@query(
    "profile_job_report",
    f"""with {FLOWS}, d as (select (sum(n) - count(*))::bigint n from (select {", ".join(FLOW_NUMBERS)}, label, count(*) n
      from flows group by all)) select true as titled, true as names_rows, true as names_duplicates from d""",
)
def _(spark, sf):
    """The report of the same job: its title, and the counts of rows and duplicates that SQL finds too."""
    df = flows(spark, sf)
    written = findings.profile_job(df, shared_path(spark, "profile-job"), label="label", key="dst_port", name="flows")
    report = spark.read.text(written["report"], wholetext=True)
    # One report and one row of each kind of facts.
    both = report.join(F.broadcast(duplicates.duplicate_rows(df))).join(F.broadcast(column_stats.table_shape(df)))
    return both.select(
        F.col("value").startswith("# Profile of flows").alias("titled"),
        F.contains("value", F.format_number("n_rows", 0)).alias("names_rows"),
        F.contains("value", F.format_number("duplicate_rows", 0)).alias("names_duplicates"),
    )
