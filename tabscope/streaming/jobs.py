"""Structured Streaming jobs: score and route requests, count windows, drop repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tabscope.functions.numeric import col
from tabscope.plans.scoring import Bundle, score_requests


def stream_table(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    """A file stream of the Parquet files in ``path`` that match ``pattern``, or that lie in folders that do."""
    # In braces a plain name is a pattern too; a path that is none would have to be a folder.
    return spark.readStream.schema(schema).parquet(f"{path.rstrip('/')}/{{{pattern}}}")


def scored_stream(requests: DataFrame, bundle: Bundle, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predictions of the valid requests: stateless, the same plan as in batch."""
    return score_requests(requests, bundle, keep=keep)[0]


def route_requests(
    requests: DataFrame, bundle: Bundle, accepted: str, rejected: str, keep: tuple[str, ...] = ()
) -> DataStreamWriter:
    """Write predictions and rejects to two tables.

    Each micro-batch owns a folder in both and replaces it when retried, so a
    batch that fails half-way leaves no repeats.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both tables come from one reading of the batch; what doesn't fit in memory waits on disk.
        batch.persist()
        try:
            good, bad = score_requests(batch, bundle, keep=keep)
            good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(write)


def windowed_breakdown(
    scored: DataFrame,
    ts: str = "ts",
    class_column: str = "predicted_class",
    window: str = "1 day",
    watermark: str = "1 hour",
) -> DataFrame:
    """Predictions per class and tumbling window; works on a stream or a table."""
    timed = scored.withWatermark(ts, watermark) if scored.isStreaming else scored
    counts = timed.groupBy(
        F.window(col(ts), window).alias("w"), col(class_column).alias("predicted_class")
    ).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("w.start").alias("window_start"), "predicted_class", "count")


def without_repeats(
    stream: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 hour"
) -> DataFrame:
    """First arrival of each key; repeats later than the watermark are not recognised.

    State holds one entry per key seen within the watermark.
    """
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process all that has arrived, then stop."""
    query: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the available rows to a Parquet table, exactly once."""
    run_available(
        stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint
    )


def append_batches(stream: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Append what ``change`` makes of each micro-batch, for work that takes tables only; a retried batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(write), checkpoint)


def update_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Store the changed rows of an aggregate, one folder per micro-batch.

    Update mode lets the watermark drop the state of windows that are over. A
    retried batch replaces its own folder and readers never miss the table; see
    ``current_rows``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(write).outputMode("update"), checkpoint)


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest state of each key of a table written by ``update_table``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*[col(k) for k in keys]).agg(F.max_by(F.struct(*[col(v) for v in values]), "batch").alias("#row"))
    return latest.select(*[col(k) for k in keys], *[F.col("#row").getField(v).alias(v) for v in values])
