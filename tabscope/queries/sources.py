"""Queries of the CSV scan, day catalogue, uploads and model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.queries import query
from tabscope.queries.fixtures import FLOW_NUMBERS, FLOWS, flows, table
from tabscope.session import shared_path, shared_root, stage_table
from tabscope.sources import csv_tables, registry, uploads


def _as_csv(df: DataFrame, path: str) -> str:
    df.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


# Names with the blanks and the repeat that real capture headers have.
MESSY = {"dst_port": " dst_port", "bytes_per_s": "bytes_per_s ", "pkts": " pkts"}


def _text(name: str, c):
    if name == "bytes_per_s":
        return F.when(c.isNull(), "NaN").when(c == float("inf"), "Infinity").otherwise(c.cast("string"))
    return c.cast("string")


@query(
    "scan_csv_flows",
    f"with {FLOWS} select *, pkts as \"pkts.1\" from flows",
)
def _(spark, sf):
    df = flows(spark, sf)
    texts = df.select(
        *[_text(c, F.col(c)).alias(MESSY.get(c, c)) for c in df.columns],
        F.col("pkts").cast("string").alias("pkts.1"),
    )
    path = _as_csv(texts, shared_path(spark, "csv"))
    return csv_tables.load_csv(spark, path)


@query(
    "scan_csv_types",
    f"""with {FLOWS} select unnest([{", ".join(f"'{c}'" for c in FLOW_NUMBERS)}, 'label', 'ok']) as column,
      unnest(['bigint', 'double', 'double', 'double', 'double', 'double', 'double', 'double',
        'string', 'boolean']) dtype, (select count(*) from flows) n""",
)
def _(spark, sf):
    df = flows(spark, sf).withColumn("ok", F.col("duration") > 0)
    texts = df.select(
        *[_text(c, F.col(c)).alias(c) for c in df.columns if c != "ok"],
        F.when(F.col("ok"), "True").otherwise("False").alias("ok"),
    )
    scanned = csv_tables.scan_text(spark, _as_csv(texts, shared_path(spark, "csv")))
    types = list(csv_tables.infer_types(scanned).items())
    n = scanned.count()
    return spark.createDataFrame([(c, t, n) for c, t in types], "column string, dtype string, n long")


@query(
    "load_multi_day",
    """select case event_type when 'click' then 'monday' when 'view' then 'tuesday' else 'wednesday' end
      as day, event_id, user_id, value, case when event_type != 'click' then event_type end event_type
    from events""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    raw = shared_path(spark, "raw")
    kind = F.col("event_type")
    days = {
        "monday": events.filter(kind == "click").select(
            "event_id", F.col("user_id").alias(" user_id"), F.col("value").alias("value ")
        ),
        "tuesday": events.filter(kind == "view").select("event_id", "value", "user_id", "event_type"),
        "wednesday": events.filter(~kind.isin("click", "view")).select(
            F.col("event_id").alias(" event_id"), "user_id", "value", "event_type"
        ),
    }
    for day, part in days.items():
        _as_csv(part, f"{raw}/{csv_tables.CAPTURE_DAYS[day]}")
    return csv_tables.load_days(spark, list(days), raw_dir=raw)


def _event_cells() -> list[Column]:
    """Texts of value and user_id, some of them no numbers."""
    e = F.col("event_id")
    value = (
        F.when(e % 50 == 0, "abc")
        .when(e % 50 == 1, "")
        .when(e % 50 == 2, "0x10")
        .when(e % 50 == 3, "1e400")
        .when(e % 50 == 4, " 7 ")
        .when(e % 50 == 5, "12d")
        .otherwise(F.col("value").cast("string"))
    )
    user = F.when(e % 70 == 69, "user-1").otherwise(F.col("user_id").cast("string"))
    return [value, user]


def _event_upload(spark: SparkSession, sf: str) -> uploads.Upload:
    value, user = _event_cells()
    rows = table(spark, sf, "events").orderBy("event_id").select(
        value.alias("value"), user.alias("user_id")
    )
    return uploads.scan_upload(spark, _as_csv(rows, shared_path(spark, "upload")))


BAD_CELLS = """placed as (select *, row_number() over (order by event_id) + 1 line from events),
bad as (
  select line, 0 ord, 'value' feature, case event_id % 50 when 0 then 'abc' when 3 then '1e400'
    else '12d' end raw from placed where event_id % 50 in (0, 3, 5)
  union all select line, 1, 'user_id', 'user-1' from placed where event_id % 70 = 69)"""


@query(
    "upload_cell_errors",
    f"""with {BAD_CELLS} select *, 'Row ' || line || ': "' || feature || '" is not a valid number ('
      || raw || ')' message from bad""",
)
def _(spark, sf):
    return uploads.cell_errors(_event_upload(spark, sf), ["value", "user_id"])


@query(
    "upload_faults",
    f"""with {BAD_CELLS} select line, ord, 'Row ' || line || ': "' || feature || '" is not a valid number ('
      || raw || ')' message from bad""",
)
def _(spark, sf):
    """Every fault of a refused upload, as the error hands them on."""
    try:
        uploads.accepted_rows(_event_upload(spark, sf), ["value", "user_id"])
    except uploads.UploadFaultsError as refused:
        return refused.faults
    raise AssertionError("an upload with bad cells was accepted")


@query(
    "upload_rows",
    """select row_number() over (order by event_id) - 1 as "row",
      case when event_id % 50 in (0, 1, 3, 5) then 0 when event_id % 50 = 2 then 16
        when event_id % 50 = 4 then 7 else value end as value,
      case when event_id % 70 = 69 then 0 else user_id::double end user_id from events""",
)
def _(spark, sf):
    return uploads.upload_rows(_event_upload(spark, sf), ["value", "user_id"])


@query(
    "upload_validate",
    """select 1 ord, 'Missing columns: session, bytes' message, 0::bigint accepted,
      (select count(*) from events) n_rows
    union all select 2, 'Unexpected columns: user_id', 0, (select count(*) from events)""",
)
def _(spark, sf):
    upload = _event_upload(spark, sf)
    expected = ["session", "value", "bytes"]
    accepted = uploads.upload_rows(upload, expected).count()
    n_rows = upload.rows.count()
    faults = uploads.header_errors(upload.columns, expected)
    rows = [(i, m, accepted, n_rows) for i, m in enumerate(faults, start=1)]
    return spark.createDataFrame(rows, "ord int, message string, accepted long, n_rows long")


@query(
    "upload_faults_wrong_header",
    f"""with {BAD_CELLS} select 1::bigint line, 0 ord, 'Unexpected columns: session' message
    union all select line, ord, 'Row ' || line || ': "' || feature || '" is not a valid number (' || raw || ')' from bad
    union all select line, -1, 'Row ' || (line - 2) || ': Too few fields: expected 3 fields but parsed 2'
      from placed where event_id % 90 = 7""",
)
def _(spark, sf):
    """An unexpected column and short rows beside bad cells: every fault is listed."""
    e = F.col("event_id")
    cells = [*_event_cells(), F.when(e % 90 != 7, e.cast("string"))]
    lines = table(spark, sf, "events").select(e.alias("ord"), F.concat_ws(",", *cells).alias("value"))
    path = shared_path(spark, "upload")
    header = spark.createDataFrame([(-1, "value,user_id,session")], "ord long, value string")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    # One file with one header, as a form sends it: many tasks sort, and the one that writes takes their stored parts in turn.
    header.unionByName(lines).orderBy("ord").select("value").checkpoint().coalesce(1).write.text(path)
    return uploads.upload_faults(uploads.scan_upload(spark, path), ["value", "user_id"])


@query(
    "scan_csv_breaks",
    """select p_partkey, p_name || chr(10) || p_type || '"' || p_brand as note, p_size::bigint p_size from part""",
)
def _(spark, sf):
    """Cells with line breaks and quotes, in files cut to small blocks."""
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit("\n"), "p_type", F.lit('"'), "p_brand").alias("note"), "p_size"
    )
    path = shared_path(spark, "breaks")
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "20000")
    try:
        return stage_table(csv_tables.load_csv(spark, path), "breaks")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@query(
    "registry_latest",
    """with names as (select case p_partkey % 4 when 0 then 'v' || p_partkey
        when 1 then 'v' || p_partkey || 'b' when 2 then 'release' || p_partkey else 'preprocessing' end
        as name from part),
    n as (select max(regexp_extract(name, '^v(\\d+)$', 1)::bigint) m from names
      where regexp_matches(name, '^v(\\d+)$'))
    select 'v' || m latest, 'v' || (m + 1) as next from n""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    names = table(spark, sf, "part").select(
        F.when(k % 4 == 0, F.concat(F.lit("v"), k.cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("v"), k.cast("string"), F.lit("b")))
        .when(k % 4 == 2, F.concat(F.lit("release"), k.cast("string")))
        .otherwise("preprocessing")
        .alias("name")
    )
    return registry.latest_and_next(names)
