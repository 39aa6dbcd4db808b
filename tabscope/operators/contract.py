"""Checks of feature records against the fitted feature list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numeric import INF, col
from tabscope.functions.text import error_line


# Records of one batch that share a salt, as far as the hash deals them evenly.
SALT_RECORDS = 100_000


def check_features(df: DataFrame, expected: list[str], features: str = "features") -> DataFrame:
    """Adds sorted ``missing_features`` and ``unexpected_features``, ``valid`` and ``detail``."""
    wanted = F.array(*[F.lit(n) for n in expected]).cast("array<string>")
    given = F.map_keys(col(features))
    checked = df.withColumn(
        "missing_features", F.array_sort(F.array_except(wanted, given))
    ).withColumn("unexpected_features", F.array_sort(F.array_except(given, wanted)))
    missing, unexpected = F.col("missing_features"), F.col("unexpected_features")
    return checked.withColumn("valid", (F.size(missing) == 0) & (F.size(unexpected) == 0)).withColumn(
        "detail", F.when(~F.col("valid"), error_line(missing, unexpected))
    )


def check_batches(checked: DataFrame, batch: str, position: str) -> DataFrame:
    """Reject a batch as a whole if one of its records is invalid.

    ``batch_valid`` and ``batch_detail`` (that of the first invalid record)
    are added. Verdicts and sizes fold within tasks. A large batch gets as many
    salts as its own size asks for, and its verdict is repeated under these.
    """
    sizes = checked.groupBy(col(batch)).agg(
        F.count(F.lit(1)).alias("#n"), F.min_by(F.when(~F.col("valid"), F.col("detail")), F.when(~F.col("valid"), col(position))).alias("batch_detail")
    )
    salts = F.ceil(F.col("#n") / SALT_RECORDS)
    failing = sizes.filter(F.col("batch_detail").isNotNull())
    # At most one row for each SALT_RECORDS records.
    large = F.broadcast(failing.filter(F.col("#n") > SALT_RECORDS).select(col(batch), salts.alias("#salts")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    verdicts = failing.select(col(batch), "batch_detail", each.alias("#salt"))
    own = F.pmod(F.hash(col(position)).cast("long"), F.coalesce("#salts", F.lit(1)))
    salted = checked.join(large, batch, "left").withColumn("#salt", own).drop("#salts")
    judged = salted.join(verdicts, [batch, "#salt"], "left").drop("#salt")
    return judged.withColumn("batch_valid", F.col("batch_detail").isNull())


def expand_features(
    df: DataFrame, expected: list[str], features: str = "features", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One double column per expected feature, in the expected order."""
    return df.select(
        *[col(c) for c in keep],
        *[F.try_element_at(col(features), F.lit(n)).cast("double").alias(n) for n in expected],
    )


def quality_gate(df: DataFrame, confidence: str, value: str) -> DataFrame:
    """Adds ``passes``: the confidence lies in [0, 1] and the value is a finite number."""
    number = col(value).try_cast("double")
    ok = col(confidence).between(0.0, 1.0) & number.isNotNull() & (F.abs(number) < F.lit(INF))
    return df.withColumn("passes", F.coalesce(ok, F.lit(False)))


def missing_columns(columns: list[str], expected: list[str]) -> list[str]:
    return sorted(set(expected) - set(columns))


def require_columns(df: DataFrame, expected: list[str], what: str) -> None:
    """Raise a ValueError that names the absent columns."""
    missing = missing_columns(df.columns, expected)
    if missing:
        raise ValueError(f"{what} is missing columns the fitted preprocessing expects: {missing}")
