"""Seeded row order that does not depend on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numeric import col


def seeded_hash(seed: int, key: Column) -> Column:
    """md5 of ``seed|key`` as 32 hex digits; its text order is the row order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def row_text(df: DataFrame) -> Column:
    """One text per distinct row: every value with its length, missing marked apart."""
    parts = []
    for name in df.columns:
        text = col(name).cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
        )
    return F.concat_ws("|", *parts)


# Bits of a number's leading digits that each of two cuts tells apart.
CUT_BITS = 18
#: Beyond the exponent of any finite number.
ENDLESS = 20_000


def order_cuts(value: Column) -> list[Column]:
    """Three whole numbers whose order agrees with that of a double: its power of two, then its leading digits.

    Each is monotone where those before it are equal, also after rounding, so
    numbers that differ in any of them are in the right order. Infinities come
    first and last.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    endless = size == float("inf")
    power = (
        F.when(value == 0, 0)
        .when(endless, F.when(value > 0, ENDLESS).otherwise(-ENDLESS))
        .when(value > 0, exponent + 10_000)
        .otherwise(-exponent - 10_000)
    )
    scaled = value / F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-1000)))
    mantissa = F.when((value == 0) | endless, 0.0).otherwise(scaled)
    coarse, fine = (F.floor(mantissa * float(1 << bits)) for bits in (CUT_BITS, 2 * CUT_BITS))
    return [power.cast("long"), coarse, fine]
