"""The data behind the profile's charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numeric import col, finite, is_missing
from tabscope.functions.ordering import row_text, seeded_hash
from tabscope.operators.column_stats import most_varying

BINS = 50
TOP_COLUMNS = 9
SAMPLE_ROWS = 2000
SAMPLE_SEED = 42


def histograms(
    df: DataFrame, profile: DataFrame, n: int = TOP_COLUMNS, bins: int = BINS
) -> DataFrame:
    """``(ord, column, bin, low, high, count)`` of the columns that vary most.

    Equal bins from minimum to maximum, numbered from 0, the last one closed;
    empty bins are listed. Only the chosen columns are read.
    """
    ranges = {
        r["column"]: (r["ord"], r["fin_min"], r["fin_max"])
        for r in most_varying(profile, n).select("ord", "column", "fin_min", "fin_max").collect()
    }
    if not ranges:
        return df.sparkSession.createDataFrame(
            [], "ord int, column string, bin int, low double, high double, count long"
        )
    types = {f.name: f.dataType for f in df.schema.fields}
    cells: list[Column] = []
    edges: list[tuple] = []
    for name, (ordinal, low, high) in ranges.items():
        v = finite(col(name), types[name])
        place = F.floor((v - F.lit(low)) * bins / (F.lit(high) - F.lit(low)))
        slot = F.when(v.isNotNull(), F.least(place, F.lit(bins - 1)))
        cells.append(F.struct(F.lit(ordinal).alias("ord"), slot.cast("int").alias("bin")))
        step = (high - low) / bins
        edges += [
            (ordinal, name, b, low + b * step, low + (b + 1) * step) for b in range(bins)
        ]
    counted = (
        df.select(F.inline(F.array(*cells))).filter("bin is not null").groupBy("ord", "bin").count()
    )
    slots = df.sparkSession.createDataFrame(
        edges, "ord int, column string, bin int, low double, high double"
    )
    return slots.join(counted, ["ord", "bin"], "left").select(
        "ord", "column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def missing_matrix(
    df: DataFrame, key: str | None = None, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Missing flags of ``n`` rows drawn by seeded hash, the whole table if smaller.

    The flags are made before the draw, so the top-k moves hashes and flags only.
    """
    order = seeded_hash(seed, col(key) if key else row_text(df))
    flags = [
        is_missing(col(f.name), f.dataType).alias(f.name)
        for f in df.schema.fields
        if f.name != key
    ]
    kept = [col(key)] if key else []
    return df.select(order.alias("#h"), *kept, *flags).orderBy("#h").limit(n).drop("#h")
