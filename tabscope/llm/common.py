"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "512"


def read_columns(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a limit set by the user is left alone."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, BATCH_ROWS)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``_id``, ``_th`` (hash of the text) and ``_text`` (null becomes empty).

    ``_id`` with ``_th`` names a document, so that rows of a null or repeated id
    are told apart by their text, and repeated rows count as one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``_id`` and ``_th``, where null ids equal each other."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def shielded(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns doc_id, text and _rest (all others), and what turns such rows back into rows of ``docs``.

    Whatever further columns are called, they can't meet those of an operator.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rest = F.struct(F.lit(True).alias("_"), *(quoted(c).alias(f"c{k}") for k, c in enumerate(others)))
    inner = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), rest.alias("_rest"))

    def restored(rows: DataFrame) -> DataFrame:
        own = {id_col: "doc_id", text_col: "text"} | {c: f"_rest.c{k}" for k, c in enumerate(others)}
        return rows.select(*(F.col(own[c]).alias(c) for c in docs.columns))

    return inner, restored


def literal_array(values: Iterable[object], kind: str) -> Column:
    """A constant array as one literal text, so that its size doesn't burden the plan."""
    return F.split(F.lit(",".join(str(x) for x in values)), ",").cast(f"array<{kind}>")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows``; pass a staged table.

    Beyond that the plain frame goes back and Spark joins it by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def told_if_small(df: DataFrame, text_col: str, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its texts, and 64 bytes a row for the rest, have at most ``most`` bytes; pass a staged table."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


@contextmanager
def without_gc() -> Iterator[None]:
    """Spares the search for cycles while very many small objects are made that have none."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()
