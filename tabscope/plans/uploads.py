"""The upload job: check a file, score it as one batch and record it in the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.history import append_history, batch_entries
from tabscope.plans.scoring import Bundle, score
from tabscope.sources.uploads import accepted_rows, scan_upload


def score_upload(
    spark: SparkSession,
    path: str,
    bundle: Bundle,
    predictions: str,
    history: str,
    batch: str,
    ts: Column | None = None,
) -> DataFrame:
    """Score an upload without faults and return its stored predictions by row.

    Predictions go to ``predictions/batch=<batch>``, which a repeated run replaces;
    the batch's size and class breakdown are added to the history once they are
    stored. A faulty upload raises with all of its faults and leaves nothing behind.
    """
    rows = accepted_rows(scan_upload(spark, path), bundle.feature_names)
    place = f"{predictions.rstrip('/')}/batch={batch}"
    score(rows, bundle, ("row",)).write.mode("overwrite").parquet(place)
    stored = spark.read.parquet(place)
    named = stored.withColumns({"batch": F.lit(batch), "ts": F.current_timestamp() if ts is None else ts})
    append_history(batch_entries(named, "batch", "ts"), history)
    return stored
