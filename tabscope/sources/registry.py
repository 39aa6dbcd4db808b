"""Versioned model folders v1, v2, ... below one root."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = r"^v(\d+)$"


#: A run's first file in its version's folder, and its last; only a folder that has the last is a model.
CLAIM, COMPLETE = "_claimed", "_complete"


def file_system(spark: SparkSession, place: str):
    """The file system of a path, on any that Spark can reach, and the path as it wants it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def list_folders(spark: SparkSession, root: str, holding: str | None = None) -> list[str]:
    """Names of the folders directly below ``root``; only those that hold a file of the given name, if one is."""
    files, path = file_system(spark, root)
    if not files.exists(path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
    return sorted(p.getName() for p in found if holding is None or files.exists(place(p, holding)))


def created(spark: SparkSession, place: str) -> bool:
    """Create an empty file; False if it is there already, also where another run is creating it just now."""
    files, path = file_system(spark, place)
    if path.toUri().getScheme() in (None, "file") and files.getUri().getScheme() == "file":
        # Hadoop's local file system looks whether a file exists and then creates it; Java does both at once.
        files.mkdirs(path.getParent())
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        return files.createNewFile(path)
    except Py4JJavaError as exc:
        if "FileAlreadyExists" in str(exc.java_exception):
            return False
        raise


def claim_version(spark: SparkSession, root: str) -> str:
    """A new version's name that no other run has: its claim is a file that only one run can create."""
    home = root.rstrip("/")
    number = int(free_version(spark, home)[1:])
    while not created(spark, f"{home}/v{number}/{CLAIM}"):
        number += 1
    return f"v{number}"


def complete_version(spark: SparkSession, root: str, version: str) -> None:
    """Marks a version as whole; until then no one loads it."""
    if not created(spark, f"{root.rstrip('/')}/{version}/{COMPLETE}"):
        raise FileExistsError(f"{version} of {root} is complete already")


def version_numbers(names: DataFrame, name: str = "name") -> DataFrame:
    """Numbers of the names that are versions; any other name is passed over."""
    return names.filter(F.col(name).rlike(VERSION)).select(
        F.regexp_extract(name, VERSION, 1).cast("long").alias("number")
    )


def latest_and_next(names: DataFrame, name: str = "name") -> DataFrame:
    """One row with the latest version (NULL without any) and the next free one."""
    top = F.max("number")
    return version_numbers(names, name).agg(
        F.concat(F.lit("v"), top.cast("string")).alias("latest"),
        F.concat(F.lit("v"), (F.coalesce(top, F.lit(0)) + 1).cast("string")).alias("next"),
    )


def version_listing(spark: SparkSession, root: str, complete: bool = True) -> DataFrame:
    """The folders below ``root`` that are versions: ``(number, path)``; those of unfinished runs too, if not ``complete``."""
    home = root.rstrip("/")
    found = list_folders(spark, home, COMPLETE if complete else None)
    folders = spark.createDataFrame([(n,) for n in found], "name string")
    return version_numbers(folders).select(
        "number", F.concat(F.lit(f"{home}/v"), F.col("number").cast("string")).alias("path")
    )


def free_version(spark: SparkSession, root: str) -> str:
    """Name for a new version: one past the highest, finished or not; v1 in an empty folder."""
    names = version_listing(spark, root, complete=False).select(F.concat(F.lit("v"), "number").alias("name"))
    return latest_and_next(names).first().next


def version_path(spark: SparkSession, root: str, wanted: str | None = None) -> str:
    """Folder of the version asked for, or of the highest if none is; unfinished ones are no versions."""
    listing = version_listing(spark, root)
    if wanted is not None:
        listing = listing.filter(F.concat(F.lit("v"), "number") == wanted)
    hit = listing.agg(F.max_by("path", "number").alias("path")).first().path
    if hit is None:
        raise FileNotFoundError(f"{root} holds no trained model" if wanted is None else f"{root} holds no model {wanted}")
    return hit
