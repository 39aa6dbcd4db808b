"""Feature CSV uploads: header check, cell check and accepted rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.numeric import col
from tabscope.session import stage_table
from tabscope.sources.records import has_breaks, read_records

CORRUPT = "#line"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


@dataclass(frozen=True)
class Upload:
    """Text rows with ``#row`` (from 0 in file order) and ``#fields`` (cells present)."""

    rows: DataFrame
    columns: list[str]


def scan_upload(spark: SparkSession, path: str) -> Upload:
    """Read an upload as text and number its rows in file order.

    A row's number is its place within its block plus the rows of the blocks
    before it, so only one count per block is gathered.
    """
    columns = spark.read.csv(path, header=True, escape='"').columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    options = {"columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
    broken = has_breaks(spark, path)
    if broken:
        names = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)
        cells = F.from_csv("value", names, options).alias("#cells")
        raw = read_records(spark, path).select("#file", "#block", "#id", cells).select("#file", "#block", "#id", "#cells.*")
    else:
        raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, **options).select(
            "*",
            F.col("_metadata.file_path").alias("#file"),
            F.col("_metadata.file_block_start").alias("#block"),
            F.monotonically_increasing_id().alias("#id"),
        )
    # A line is only found short or long while all of its cells are parsed, so
    # the count refers to every column and none can be pruned from under it.
    whole = F.length(F.concat_ws("", *[col(c) for c in columns])) >= 0
    fields = F.when(
        col(CORRUPT).isNotNull(), F.size(F.split(col(CORRUPT), COMMA_OUTSIDE_QUOTES))
    ).when(whole, F.lit(len(columns)))
    placed = raw.select(
        *[col(c) for c in columns],
        fields.alias("#fields"),
        "#file",
        "#block",
        "#id",
    )
    blocks = placed.groupBy("#file", "#block").agg(
        F.count(F.lit(1)).alias("#n"), F.min("#id").alias("#first")
    )
    before = F.sum("#n").over(
        Window.orderBy("#file", "#block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "#file", "#block", (F.coalesce(before, F.lit(0)) - F.col("#first")).alias("#shift")
    )
    # A row for each block, while a block's rows would all go to one task.
    rows = placed.join(F.broadcast(offsets), ["#file", "#block"]).select(
        (F.col("#id") + F.col("#shift")).alias("#row"), "#fields", *[col(c) for c in columns]
    )
    return Upload(rows, columns)


def header_errors(columns: list[str], expected: list[str]) -> list[str]:
    """Missing columns in expected order, then unexpected ones in file order."""
    missing = [c for c in expected if c not in columns]
    unexpected = [c for c in columns if c not in expected]
    out = []
    if missing:
        out.append(f"Missing columns: {', '.join(missing)}")
    if unexpected:
        out.append(f"Unexpected columns: {', '.join(unexpected)}")
    return out


def number(text: Column) -> Column:
    """The number a form cell holds, or NULL: blank is 0, prefixes 0x 0o 0b are read."""
    t = F.trim(text)
    prefixed = t.rlike(r"^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$")
    base = F.substring(F.lower(t), 2, 1)
    digits = F.substring(t, 3, 64)
    whole = (
        F.when(base == "x", F.conv(digits, 16, 10))
        .when(base == "o", F.conv(digits, 8, 10))
        .otherwise(F.conv(digits, 2, 10))
    )
    value = (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(DECIMAL), t.try_cast("double"))
        .when(prefixed, whole.try_cast("double"))
    )
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _cells(upload: Upload, expected: list[str]) -> DataFrame:
    place = {c: i for i, c in enumerate(upload.columns)}
    present = [
        F.when(F.col("#fields") > place[f], F.coalesce(col(f), F.lit(""))) for f in expected
    ]
    return upload.rows.select(
        F.col("#row").alias("row"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"), text.alias("raw"))
                    for i, (f, text) in enumerate(zip(expected, present))
                ]
            )
        ),
    )


def cell_errors(upload: Upload, expected: list[str]) -> DataFrame:
    """One row per cell that is not a finite number; lines count the header as 1."""
    if any(f not in upload.columns for f in expected):
        return upload.rows.sparkSession.createDataFrame(
            [], "line long, ord int, feature string, raw string, message string"
        )
    bad = _cells(upload, expected).filter(number(F.col("raw")).isNull())
    line = (F.col("row") + 2).cast("long")
    raw = F.coalesce("raw", F.lit("undefined"))
    return bad.select(
        line.alias("line"),
        "ord",
        "feature",
        raw.alias("raw"),
        F.concat(
            F.lit("Row "), line.cast("string"), F.lit(': "'), F.col("feature"),
            F.lit('" is not a valid number ('), raw, F.lit(")"),
        ).alias("message"),
    )


def field_errors(upload: Upload) -> DataFrame:
    """Rows with more or fewer cells than the header."""
    n = len(upload.columns)
    wrong = upload.rows.filter(F.col("#fields") != n)
    side = F.when(F.col("#fields") < n, "few").otherwise("many")
    return wrong.select(
        F.col("#row").alias("row"),
        F.concat(
            F.lit("Row "), F.col("#row").cast("string"), F.lit(": Too "), side,
            F.lit(f" fields: expected {n} fields but parsed "), F.col("#fields").cast("string"),
        ).alias("message"),
    )


def upload_rows(upload: Upload, expected: list[str]) -> DataFrame:
    """The rows as numbers, in expected order, a bad cell as 0; none if a column is missing."""
    if any(f not in upload.columns for f in expected):
        schema = ", ".join(["row long", *[f"`{f}` double" for f in expected]])
        return upload.rows.sparkSession.createDataFrame([], schema)
    return upload.rows.select(
        F.col("#row").alias("row"),
        *[F.coalesce(number(F.coalesce(col(f), F.lit(""))), F.lit(0.0)).alias(f) for f in expected],
    )


class UploadFaultsError(ValueError):
    """An upload was refused; ``faults`` holds every fault, ``count`` their number."""

    def __init__(self, faults: DataFrame, count: int, first: list[str]):
        self.faults, self.count = faults, count
        super().__init__(f"{count} faults, all in .faults; the first: {'; '.join(first)}")


def upload_faults(upload: Upload, expected: list[str]) -> DataFrame:
    """Every fault as ``(line, ord, message)``: of the header, of rows with too few or many cells, and of cells.

    Cells are not judged while an expected column is missing. Faults of the
    header and an upload without rows have line 1; lines count the header as 1,
    and ``ord`` orders the faults of a line.
    """
    spark = upload.rows.sparkSession
    schema = "line long, ord int, message string"
    messages = header_errors(upload.columns, expected)
    header = spark.createDataFrame([(1, i, m) for i, m in enumerate(messages)], schema)
    # Row texts of the parser count from 0 after the header.
    fields = field_errors(upload).select((F.col("row") + 2).cast("long").alias("line"), F.lit(-1).alias("ord"), "message")
    cells = cell_errors(upload, expected).select("line", "ord", "message")
    empty = upload.rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    place = F.lit(len(messages))
    none = empty.select(F.lit(1).cast("long").alias("line"), place.alias("ord"), F.lit("the upload has no rows").alias("message"))
    return header.unionByName(fields).unionByName(cells).unionByName(none)


def accepted_rows(upload: Upload, expected: list[str], shown: int = 10) -> DataFrame:
    """The rows of an upload without any fault; else an error that holds all faults and shows the first."""
    faults = stage_table(upload_faults(upload, expected), "upload-faults")
    count = faults.count()
    if count:
        first = [r.message for r in faults.orderBy("line", "ord").limit(shown).collect()]
        raise UploadFaultsError(faults, count, first)
    return upload_rows(upload, expected)
