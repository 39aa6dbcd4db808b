"""Column expressions for missing, infinite and scaled values.

Missing means NULL or NaN. Infinities are values until a caller asks for
``finite``. Everything here stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def quoted(name: str) -> str:
    """Backtick a column name, so dots, slashes and blanks are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def known(c: Column, dtype: T.DataType) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(c), c) if is_floating(dtype) else c


def is_missing(c: Column, dtype: T.DataType) -> Column:
    return (c.isNull() | F.isnan(c)) if is_floating(dtype) else c.isNull()


def finite(c: Column, dtype: T.DataType) -> Column:
    """The value as a double, or NULL where it is NaN or infinite.

    NaN sorts above infinity in Spark, so one comparison rules out both.
    """
    value = c.cast("double")
    return F.when(F.abs(value) < F.lit(INF), value) if is_floating(dtype) else value


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    """Share in percent rounded to 4 decimals; 0 for an empty table."""
    return F.round(ratio(part.cast("double"), whole.cast("double")) * 100, 4)


# The same expressions as SQL text. A wide table needs hundreds of them, and
# one parsed text per column costs the driver far less than a tree of calls.


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    """A double literal that keeps every digit."""
    if value != value or abs(value) == INF:
        return f"double('{value}')"
    return f"{float(value)!r}D"


def known_sql(name: str, dtype: T.DataType) -> str:
    c = quoted(name)
    return f"CASE WHEN NOT isnan({c}) THEN {c} END" if is_floating(dtype) else c


def finite_sql(name: str, dtype: T.DataType) -> str:
    value = f"CAST({quoted(name)} AS DOUBLE)"
    if is_floating(dtype):
        return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"
    return value
