"""CSV records that may hold line breaks inside quotes, from files that stay splittable.

Files are read by lines, a block of a file per split. Whether a line begins
inside quotes depends on all lines before it, so each block first says how it
leaves for either way of entering it; from these, in the order of the blocks,
follows how each block is entered. Blocks then cut their own records. Only the
pieces of records that cross a block's edge, two a block at most, are put
together afterwards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that leave no quotes open: each cell is quoted and closed, or doesn't begin with a quote.
CLOSED = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?(?:,|$))+$'
#: What a line does from a cell's beginning on, up to quotes that stay open.
CELLS = re.compile(r'(?:"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*)?(?:,|$)')
#: What closes quotes that a line begins in.
CLOSING = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:,|$)')
WHOLE, OPENS, INSIDE, CLOSES = range(4)
#: Bytes that a task takes of small blocks where there are many.
TASK_BYTES = 32 << 20
PLACE = ("#file", "#block")


def leaves_open(line: str, inside: bool) -> bool:
    """Whether quotes are open behind a line, by whether they were before it."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        found = CLOSING.match(line)
        if not found:
            return True
        at = found.end()
        if at == len(line) and not line.endswith(","):
            return False
    while at < len(line):
        found = CELLS.match(line, at)
        if not found:
            return True
        at = found.end()
    return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their blocks; a task takes small blocks one after the other, as each has only a row to say."""
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("#file"), F.col("_metadata.file_block_start").alias("#block")
    )
    blocks = lines.rdd.getNumPartitions()
    full = math.ceil(blocks * block_bytes(spark) / TASK_BYTES)
    return lines.coalesce(max(1, min(blocks, max(full, 4 * spark.sparkContext.defaultParallelism))))


def block_bytes(spark: SparkSession) -> int:
    """The most that Spark reads as one block."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)(?:i?b)?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def has_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any cell goes on in the next line; ends at the first line that leaves quotes open."""
    value = F.col("value")
    return not spark.read.text(path).filter(value.contains('"') & ~value.rlike(CLOSED)).isEmpty()


def block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(file, block, ...) and the lines of one block in each batch, in their order; a block may come in several."""
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns)), strict=True))
        values = batch.column(0).to_pylist()
        first = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or keys[k] != keys[first]:
                yield keys[first], values[first:k]
                first = k


def entered_inside(lines: DataFrame) -> DataFrame:
    """Blocks that begin inside quotes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[tuple, tuple[bool, bool]] = {}
        for key, values in block_rows(batches):
            a, b = ways.get(key, (False, True))
            for line in values:
                if '"' in line:
                    a, b = leaves_open(line, a), leaves_open(line, b)
            ways[key] = (a, b)
        rows = [[k[0] for k in ways], [k[1] for k in ways], [w[0] for w in ways.values()], [w[1] for w in ways.values()]]
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["#file", "#block", "a", "b"])

    ways = lines.mapInArrow(run, "`#file` string, `#block` long, a boolean, b boolean")
    # A block sets how it leaves, or keeps or turns how it was entered: what holds before a block
    # is what the last one to set it has set, turned as often as blocks since have turned it.
    before = Window.partitionBy("#file").orderBy("#block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("a") & ~F.col("b"), 1).otherwise(0)).over(before), F.lit(0))
    counted = ways.withColumn("turns", turns)
    last = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "turns")), ignorenulls=True).over(before)
    told = counted.withColumn("last", last)
    set_to = F.coalesce(F.col("last.a").cast("int"), F.lit(0))
    inside = (set_to + F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    return told.filter(inside).select(*PLACE, F.lit(True).alias("#inside"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``#file``, ``#block``, ``#id`` (from 0 within the block) and ``value`` of all records but each file's header and empty ones.

    A record belongs to the block in which it begins. Quotes that are never closed take the rest of their file.
    """
    lines = lines_of(spark, path)
    # A row for each block at most, so some bytes for the many megabytes of a block.
    entered = F.broadcast(entered_inside(lines))
    placed = lines.join(entered, list(PLACE), "left").select("value", *PLACE, F.coalesce("#inside", F.lit(False)).alias("#inside"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, piece, kind, number = None, False, [], WHOLE, 0
        out: list[tuple] = []

        def put(kind: int) -> None:
            nonlocal number
            text = "\n".join(piece)
            piece.clear()
            # The first record of a file names its columns.
            header = key[1] == 0 and number == 0 and kind in (WHOLE, OPENS)
            if kind == WHOLE and not text.strip():
                return
            if kind in (WHOLE, OPENS):
                number += 1
            out.append((key[0], key[1], number - 1 - (key[1] == 0), kind, header, text))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["#file", "#block", "#id", "kind", "header", "value"]
            )

        for own, values in block_rows(batches):
            if own != key:
                if piece:
                    put(INSIDE if kind == CLOSES else OPENS)
                key, open_, number = own, own[2], 0
                kind = CLOSES if open_ else WHOLE
            for line in values:
                open_ = leaves_open(line, open_)
                piece.append(line)
                if not open_:
                    put(kind)
                    kind = WHOLE
            if out:
                yield taken()
        if piece:
            put(INSIDE if kind == CLOSES else OPENS)
            yield taken()

    cut = placed.mapInArrow(run, "`#file` string, `#block` long, `#id` long, kind int, header boolean, value string")
    whole = cut.filter(F.col("kind") == WHOLE)
    pieces = cut.filter(F.col("kind") != WHOLE)
    # A block closes what came before it, then may open its last record.
    order = F.struct("#block", (F.col("kind") == OPENS).cast("int").alias("late"))
    upto = Window.partitionBy("#file").orderBy(order)
    pieces = pieces.withColumns({"order": order, "first": F.sum((F.col("kind") == OPENS).cast("int")).over(upto)})
    start = lambda c: F.min_by(c, "order").alias(c)
    parts = F.sort_array(F.collect_list(F.struct("order", "value")))
    joined = pieces.groupBy("#file", "first").agg(
        *(start(c) for c in ("#block", "#id", "header")), F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("value")
    )
    columns = [*PLACE, "#id", "value"]
    return whole.filter("not header").select(*columns).unionByName(joined.filter("not header").select(*columns))


def header_record(spark: SparkSession, path: str) -> str | None:
    """The first record of one of the files, with its line breaks."""
    text: list[str] = []
    # A header of more lines than this is taken for a file whose quotes never close.
    for row in spark.read.text(path).limit(1000).collect():
        text.append(row.value)
        if not leaves_open("\n".join(text), False):
            return "\n".join(text).lstrip("﻿")
    return text[0].lstrip("﻿") if text else None
