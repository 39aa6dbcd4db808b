"""Formatting of numbers and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
# Fixed unit names, each 1024 times the one before.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def thousands(c: Column) -> Column:
    """1234567 as '1,234,567'."""
    return F.format_number(c, 0)


def byte_size(c: Column) -> Column:
    """Bytes in the largest unit that keeps the number below 1024, two decimals."""
    out = None
    for power, unit in reversed(list(enumerate(BYTE_UNITS))):
        # Ties go to the even digit, as powers of two meet them exactly.
        size = F.bround(c.cast("double") / F.lit(float(1024**power)), 2)
        text = F.format_string("%.2f " + unit, size)
        if out is None:
            out = text
        else:
            out = F.when(c < F.lit(float(1024 ** (power + 1))), text).otherwise(out)
    return out


def _or_dash(c: Column, text: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(DASH)).otherwise(text)


def metric(c: Column, digits: int = 3) -> Column:
    """A metric with fixed decimals, a dash when unknown."""
    return _or_dash(c, F.format_string(f"%.{digits}f", c))


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage, a dash when unknown."""
    return _or_dash(c, F.format_string(f"%.{digits}f%%", c * 100))


def title(c: Column) -> Column:
    """'missing_value_matrix' as 'Missing Value Matrix'."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def name_list(names: Column) -> Column:
    return F.concat_ws(", ", names)


def error_line(missing: Column, unexpected: Column) -> Column:
    """The non-empty reasons on one line, each as 'key words: a, b'."""
    parts = [
        F.when(F.size(names) > 0, F.concat(F.lit(f"{key}: "), name_list(names)))
        for key, names in (("missing features", missing), ("unexpected features", unexpected))
    ]
    return F.concat_ws(f" {DASH} ", *parts)
