"""CSV scan with whole-file type inference, and the catalogue of capture days."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.numeric import col, quoted, sql_text
from tabscope.sources.records import has_breaks, header_record, read_records

# Texts that a CSV cell uses for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# File name of each capture day of the public CICIDS2017 bundle.
CAPTURE_DAYS = {
    "monday": "Monday-WorkingHours.pcap_ISCX.csv",
    "tuesday": "Tuesday-WorkingHours.pcap_ISCX.csv",
    "wednesday": "Wednesday-workingHours.pcap_ISCX.csv",
    "thursday_morning_webattacks": "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "thursday_afternoon_infiltration": "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "friday_morning": "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "friday_afternoon_portscan": "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    "friday_afternoon_ddos": "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
}
DEFAULT_DAY = "wednesday"

# Patterns decide before any cast: a cast that fails costs an exception per cell.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"
# Kinds of cell text, ordered so that the widest decides a column's type.
MISSING, LOGICAL, WHOLE, REAL, TEXT = range(5)


class CaptureMissingError(FileNotFoundError):
    """The file of a catalogued capture day is not there."""


def resolve_day(
    spark: SparkSession, day: str, raw_dir: str, catalog: dict[str, str] | None = None
) -> str:
    """Path of a capture day; nothing is downloaded."""
    days = catalog or CAPTURE_DAYS
    file = days.get(day)
    if file is None:
        raise ValueError(f"no capture is catalogued under {day!r}, only under {', '.join(sorted(days))}")
    path = "/".join((raw_dir.rstrip("/"), file))
    try:
        spark.read.text(path).schema
    except AnalysisException as exc:
        raise CaptureMissingError(f"the capture of {day} is missing: {path}") from exc
    return path


def header_names(line: str, normalize: bool = True) -> list[str]:
    """Column names of a header line: repeats get '.1', '.2'; then blanks are stripped."""
    seen: dict[str, int] = {}
    names: list[str] = []
    for raw in next(csv.reader(line.splitlines(keepends=True))):
        name = raw
        while name in names:
            seen[raw] = seen.get(raw, 0) + 1
            name = f"{raw}.{seen[raw]}"
        names.append(name)
    if normalize:
        names = [n.strip() for n in names]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"column names collide once stripped: {repeated}")
    return names


def scan_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cells of all records but the headers; a quote inside quotes is written twice."""
    if not has_breaks(spark, path):
        return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, escape='"')
    names = ", ".join(f"{quoted(n)} string" for n in schema.names)
    cells = F.from_csv("value", names, {"escape": '"', "mode": "PERMISSIVE"})
    return read_records(spark, path).select(cells.alias("_")).select("_.*")


def scan_text(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Every cell as text; NULL where it stands for a missing value."""
    first = header_record(spark, path)
    if first is None:
        raise ValueError(f"{path} has no header line")
    names = header_names(first, normalize)
    positions = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = scan_cells(spark, path, positions)
    return raw.select(
        *[
            F.when(~F.col(f"c{i}").isin(*MISSING_TEXTS), F.col(f"c{i}")).alias(n)
            for i, n in enumerate(names)
        ]
    )


def _kind(name: str) -> str:
    """What a cell could be; a whole number beyond 64 bits is a real one."""
    c = quoted(name)
    return f"""CASE WHEN {c} IS NULL THEN {MISSING}
        WHEN {c} RLIKE {sql_text(INTEGER)}
          THEN CASE WHEN try_cast({c} AS BIGINT) IS NULL THEN {REAL} ELSE {WHOLE} END
        WHEN {c} RLIKE {sql_text(NUMBER)} THEN {REAL}
        WHEN {c} IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false') THEN {LOGICAL}
        ELSE {TEXT} END"""


def infer_types(texts: DataFrame) -> dict[str, str]:
    """Column types from every row of the table: one distributed aggregate.

    Per column only the widest kind of cell, whether any is missing, and
    whether logical texts mix with numbers reach the driver.
    """
    n = range(len(texts.columns))
    kinds = texts.selectExpr(*[f"{_kind(c)} AS k{i}" for i, c in enumerate(texts.columns)])
    row = kinds.agg(
        *[
            F.expr(
                f"named_struct('kind', max(k{i}), 'missing', bool_or(k{i} = {MISSING}), "
                f"'logical', bool_or(k{i} = {LOGICAL})) AS c{i}"
            )
            for i in n
        ]
    ).first()
    types = {}
    for name, cell in zip(texts.columns, row):
        if cell.kind == LOGICAL:
            types[name] = "string" if cell.missing else "boolean"
        elif cell.logical or cell.kind == TEXT:
            types[name] = "string"
        elif cell.kind == WHOLE:
            types[name] = "double" if cell.missing else "bigint"
        else:
            types[name] = "double"
    return types


def apply_types(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast by the given types; a cell that does not fit raises."""
    return texts.select(
        *[
            col(n).alias(n) if types[n] == "string" else col(n).cast(types[n]).alias(n)
            for n in texts.columns
        ]
    )


def load_csv(
    spark: SparkSession, path: str, *, normalize: bool = True, types: dict[str, str] | None = None
) -> DataFrame:
    """One CSV as a typed table. Give ``types`` to spare the inference pass."""
    texts = scan_text(spark, path, normalize)
    return apply_types(texts, infer_types(texts) if types is None else types)


def load_day(
    spark: SparkSession,
    day: str = DEFAULT_DAY,
    *,
    raw_dir: str,
    normalize: bool = True,
    catalog: dict[str, str] | None = None,
) -> DataFrame:
    return load_csv(spark, resolve_day(spark, day, raw_dir, catalog), normalize=normalize)


def load_days(
    spark: SparkSession, days: list[str], *, raw_dir: str, catalog: dict[str, str] | None = None
) -> DataFrame:
    """Several days as one table with a ``day`` column, matched by column name."""
    parts = [
        load_day(spark, d, raw_dir=raw_dir, catalog=catalog).withColumn("day", F.lit(d))
        for d in days
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
