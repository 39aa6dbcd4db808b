"""Session set-up for local runs and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tabscope", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prefer_small_methods(spark: SparkSession) -> None:
    """Have Spark avoid generated methods that the JVM would never compile.

    HotSpot leaves methods beyond 8,000 bytes of code to its interpreter. A
    projection of 78 scaled features exceeds that by far and ran five times
    slower fused into one method. A limit set by the user is left alone.
    """
    key, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, "8000")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tabscope-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage on shared storage, and unlike a cached or checkpointed
    frame later passes still prune columns and push filters to the scan.
    """
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
