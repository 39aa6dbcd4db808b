"""Per-column statistics in one pass, and the column rules built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.numeric import (
    INF,
    col,
    finite_sql,
    is_floating,
    is_numeric,
    known_sql,
    pct,
    sql_text,
)

# Fixed thresholds of the column rules.
LOW_VARIANCE = 0.01
CORRELATION = 0.95

# Columns per aggregate. A wider aggregate outgrows the code generator's
# method limit and runs interpreted; on a columnar source each chunk reads
# only its own columns, so chunking costs no extra input.
CHUNK = 8


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns in schema order."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def select_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df, exclude)])


def replace_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite values become missing in ``columns`` (default: every numeric column)."""
    wanted = set(numeric_columns(df) if columns is None else columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = wanted - set(types)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(
        *[
            F.when(F.abs(col(c)) < F.lit(INF), col(c)).alias(c)
            if c in wanted and is_floating(t)
            else col(c)
            for c, t in types.items()
        ]
    )


def chunked(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _inputs(ordinal: int, field: T.StructField) -> list[str]:
    """What the aggregates of one column read: the known value and the finite one.

    Made in a projection below the aggregate, so that each is computed once.
    """
    value = known_sql(field.name, field.dataType)
    if not is_numeric(field.dataType):
        return [f"CAST({value} AS STRING) AS v{ordinal}"]
    return [f"{value} AS v{ordinal}", f"{finite_sql(field.name, field.dataType)} AS f{ordinal}"]


def _measures(ordinal: int, field: T.StructField) -> str:
    """The aggregates of one column as a struct of a type all columns share."""
    dtype, value = field.dataType, f"v{ordinal}"
    n_finite = plus = "0"
    low = high = mean = var = "NULL"
    if is_numeric(dtype):
        fin = f"f{ordinal}"
        n_finite = f"count({fin})"
        low, high, mean, var = f"min({fin})", f"max({fin})", f"avg({fin})", f"var_samp({fin})"
        octets = "count(1) * 8"
        if is_floating(dtype):
            plus = f"count_if(CAST({value} AS DOUBLE) = double('Infinity'))"
            one_value = f"{low} <=> {high}"
        else:
            # Compared as they are: doubles cannot tell large whole numbers apart.
            one_value = f"min({value}) <=> max({value})"
    else:
        one_value = f"min({value}) <=> max({value})"
        octets = f"coalesce(sum(octet_length({value})), 0)"
    return f"""named_struct(
        'ord', {ordinal},
        'column', {sql_text(field.name)},
        'dtype', {sql_text(dtype.simpleString())},
        'numeric', {str(is_numeric(dtype)).lower()},
        'n_rows', count(1),
        'n_known', count({value}),
        'n_finite', CAST({n_finite} AS LONG),
        'n_plus_inf', CAST({plus} AS LONG),
        'fin_min', CAST({low} AS DOUBLE),
        'fin_max', CAST({high} AS DOUBLE),
        'fin_mean', CAST({mean} AS DOUBLE),
        'fin_var', CAST({var} AS DOUBLE),
        'one_value', {one_value},
        'octets', CAST({octets} AS LONG)) AS s{ordinal}"""


def column_profile(
    df: DataFrame, columns: list[str] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per column: counts, range, moments and the constant flag.

    Only finite moments are aggregated. The plain mean, deviation, minimum
    and maximum, in which infinities count, follow from them and the number
    of infinities of each sign.
    """
    fields = [
        (i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in set(columns)
    ]
    if not fields:
        raise ValueError("no columns to profile")
    parts = []
    for group in chunked(fields, chunk):
        ready = df.selectExpr(*[e for i, f in group for e in _inputs(i, f)])
        wide = ready.agg(*[F.expr(_measures(i, f)) for i, f in group])
        parts.append(wide.selectExpr(f"inline(array({', '.join(f's{i}' for i, _ in group)}))"))
    return profiled(reduce(DataFrame.union, parts))


def profiled(long: DataFrame) -> DataFrame:
    """The profile from one row of plain counts, extremes and moments per column."""
    infinite = F.when(F.col("numeric"), F.col("n_known") - F.col("n_finite")).otherwise(F.lit(0))
    minus = infinite - F.col("n_plus_inf")
    missing = F.col("n_rows") - F.col("n_known")
    spread = F.col("fin_max") - F.col("fin_min")
    constant = (missing == F.col("n_rows")) | (
        (missing == 0)
        & F.when(~F.col("numeric") | (infinite == 0), F.col("one_value")).otherwise(
            (F.col("n_finite") == 0) & ((F.col("n_plus_inf") == 0) | (minus == 0))
        )
    )
    return long.select(
        "ord",
        "column",
        "dtype",
        "numeric",
        "n_rows",
        missing.alias("n_missing"),
        pct(missing, F.col("n_rows")).alias("pct_missing"),
        infinite.alias("n_infinite"),
        "n_known",
        "n_finite",
        F.when(infinite == 0, F.col("fin_mean"))
        .when(minus == 0, F.lit(INF))
        .when(F.col("n_plus_inf") == 0, F.lit(-INF))
        .alias("mean"),
        F.when(infinite == 0, F.sqrt("fin_var")).alias("std"),
        F.when(minus > 0, F.lit(-INF))
        .otherwise(F.coalesce("fin_min", F.when(infinite > 0, F.lit(INF))))
        .alias("min"),
        F.when(F.col("n_plus_inf") > 0, F.lit(INF))
        .otherwise(F.coalesce("fin_max", F.when(infinite > 0, F.lit(-INF))))
        .alias("max"),
        "fin_min",
        "fin_max",
        "fin_mean",
        "fin_var",
        F.try_divide(F.col("fin_var"), spread * spread).alias("norm_var"),
        constant.alias("constant"),
        "octets",
    )


def missing_values(profile: DataFrame) -> DataFrame:
    """Columns with missing values: count and percentage of the rows."""
    return profile.filter("n_missing > 0").select(
        "ord", "column", F.col("n_missing").alias("count"), F.col("pct_missing").alias("pct")
    )


def infinite_values(profile: DataFrame) -> DataFrame:
    return profile.filter("n_infinite > 0").select(
        "ord", "column", F.col("n_infinite").alias("count")
    )


def constant_columns(profile: DataFrame) -> DataFrame:
    """Columns of at most one distinct value, missing counted as a value."""
    return profile.filter("constant").select("ord", "column")


def normalized_variance(profile: DataFrame) -> DataFrame:
    """Variance of each numeric column after scaling its finite values to [0, 1]."""
    return profile.filter("numeric and fin_max > fin_min").select("ord", "column", "norm_var")


def low_variance_columns(profile: DataFrame, threshold: float = LOW_VARIANCE) -> DataFrame:
    """Numeric columns, not constant, with a normalised variance below ``threshold``."""
    return profile.filter(
        F.col("numeric") & ~F.col("constant") & (F.col("fin_max") > F.col("fin_min"))
    ).filter(F.col("norm_var") < threshold).select(
        "ord", "column", F.round("norm_var", 6).alias("variance")
    )


def worst_missing(profile: DataFrame, n: int = 5) -> DataFrame:
    return missing_values(profile).orderBy(F.desc("count"), "ord").limit(n)


def most_varying(profile: DataFrame, n: int = 9) -> DataFrame:
    """Profile rows of the columns with the largest normalised variance."""
    varying = profile.filter("numeric and fin_max > fin_min")
    return varying.orderBy(F.desc("norm_var"), "ord").limit(n)


def top_variance(profile: DataFrame, n: int = 9) -> DataFrame:
    return most_varying(profile, n).select("ord", "column", "norm_var")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long")
    )


def size_estimate(profile: DataFrame) -> DataFrame:
    """Bytes of the values: 8 per numeric cell plus the octets of the texts."""
    return profile.agg(F.sum("octets").alias("size_bytes"))


def column_types(df: DataFrame) -> DataFrame:
    """Column names and types as rows, in schema order."""
    pairs = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(pairs, "ord int, column string, dtype string")
