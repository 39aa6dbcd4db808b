"""Exact quantiles with linear interpolation, at any table size.

Spark's ``percentile`` keeps every distinct value of a column in one task. Here
doubles become 64-bit numbers of the same order. Tasks count their leading 16
bits in arrays of fixed size; where a wanted rank lies in a cut of many values,
the next 16 bits of that cut are counted in one more pass, and so on. The values
of small cuts are then read off their running counts. Ties are counts, so a
value that holds any share of the rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.numeric import known_sql, sql_number, sql_text
from tabscope.operators.scan import BITS, CELLS, ENDLESS, SCAN_COLUMNS, from_keys, leading, numeric_values, order_keys, scan_table

QUARTILES = (0.25, 0.5, 0.75)
#: A cut of at most so many values is finished by its values.
CUT_VALUES = 1 << 18


def _values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: f"CAST({known_sql(c, types[c])} AS DOUBLE)" for c in columns}


def _hits(cells: DataFrame, wanted: DataFrame) -> list:
    """Of each wanted (ord, cut, statistic, rank) the cell its rank falls on, the rank inside it, and the cell's values."""
    running = Window.partitionBy("ord", "cut").orderBy("cell")
    upto = cells.withColumn("upto", F.sum("n").over(running))
    # Wanted: a few ranks of each column.
    hit = upto.join(F.broadcast(wanted), ["ord", "cut"]).filter("rank < upto AND rank >= upto - n")
    return hit.select("ord", "cut", "cell", "statistic", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "n").collect()


def _inside(batch: pa.RecordBatch, cuts: dict[int, np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each wanted column the keys of the values in its cuts, with their cuts."""
    for i, own in cuts.items():
        z = batch.column(i).to_numpy(zero_copy_only=False)
        keys = order_keys(z[~np.isnan(z)])
        cut = leading(keys, bits)
        held = np.isin(cut, own)
        if held.any():
            yield i, keys[held], cut[held]


def _refined(values: DataFrame, cuts: dict[int, np.ndarray], bits: int) -> DataFrame:
    """(ord, cut, cell, n): the next bits of the values in the cuts, counted inside tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(i, int(c)): np.zeros(CELLS, dtype=np.int64) for i, own in cuts.items() for c in own}
        for batch in batches:
            for i, keys, cut in _inside(batch, cuts, bits):
                cell = leading(keys, bits + BITS) & (CELLS - 1)
                for c in np.unique(cut).tolist():
                    counts[i, c] += np.bincount(cell[cut == c], minlength=CELLS)
        for (i, c), n in counts.items():
            at = np.flatnonzero(n)
            columns = [np.full(len(at), i, dtype=np.int32), np.full(len(at), c), at, n[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["ord", "cut", "cell", "n"])

    counted = values.mapInArrow(run, "ord int, cut long, cell long, n long")
    return counted.groupBy("ord", "cut", "cell").agg(F.sum("n").alias("n"))


def _distinct(values: DataFrame, cuts: dict[int, np.ndarray], bits: int) -> DataFrame:
    """(ord, cut, cell, n): the values of the cuts as keys whose order is that of signed numbers, with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, keys, cut in _inside(batch, cuts, bits):
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                columns = [np.full(len(found), i, dtype=np.int32), cut[first], (found ^ np.uint64(1 << 63)).view(np.int64), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["ord", "cut", "cell", "n"])

    return values.mapInArrow(run, "ord int, cut long, cell long, n long").groupBy("ord", "cut", "cell").agg(F.sum("n").alias("n"))


def order_statistics(values: DataFrame, cells: DataFrame, ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each (ord, rank), given the counts (ord, cell, n) of the columns' leading bits."""
    spark = values.sparkSession
    schema = "ord int, cut long, statistic long, rank long"
    wanted = spark.createDataFrame([(i, 0, r, r) for i, r in ranks], schema)
    hits = _hits(cells.withColumn("cut", F.lit(0).cast("long")), wanted) if ranks else []
    todo = [(h["ord"], h["cell"], h["statistic"], h["rank"], h["n"]) for h in hits]
    bits, out = BITS, {}
    while todo:
        # All 64 bits are the value itself.
        large = [t for t in todo if t[4] > CUT_VALUES and bits < 64]
        small = [t for t in todo if not (t[4] > CUT_VALUES and bits < 64)]
        if bits == 64:
            for i, cut, statistic, _, _ in todo:
                out[i, statistic] = float(from_keys(np.array([cut], dtype=np.int64).view(np.uint64))[0])
            break
        if small:
            asked = spark.createDataFrame([t[:4] for t in small], schema)
            for h in _hits(_distinct(values, cuts_of(small), bits), asked):
                key = np.array([h["cell"]], dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
                out[h["ord"], h["statistic"]] = float(from_keys(key)[0])
        todo = []
        if large:
            asked = spark.createDataFrame([t[:4] for t in large], schema)
            for h in _hits(_refined(values, cuts_of(large), bits), asked):
                cut = np.array([(int(h["cut"]) << BITS) | int(h["cell"])], dtype=np.uint64).view(np.int64)[0]
                todo.append((h["ord"], int(cut), h["statistic"], h["rank"], h["n"]))
            bits += BITS
    return out


def cuts_of(todo: list[tuple]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for i, cut, *_ in todo:
        out.setdefault(i, []).append(cut)
    return {i: np.unique(np.array(own, dtype=np.int64)) for i, own in out.items()}


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: tuple[float, ...] = QUARTILES,
    *,
    finite_only: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(ord, column, prob, value)``; missing values are left out.

    Infinities count as values unless ``finite_only``. A column without values has
    NULL quantiles. ``cells`` are the columns' counts of leading bits (ord, cell,
    n) from a pass that was made anyway.
    """
    spark = df.sparkSession
    if len(columns) > SCAN_COLUMNS:
        parts = [columns[k : k + SCAN_COLUMNS] for k in range(0, len(columns), SCAN_COLUMNS)]
        out = exact_quantiles(df, parts[0], probs, finite_only=finite_only)
        for k, part in enumerate(parts[1:], 1):
            more = exact_quantiles(df, part, probs, finite_only=finite_only)
            out = out.unionByName(more.withColumn("ord", F.col("ord") + k * SCAN_COLUMNS))
        return out
    if cells is None:
        cells = scan_table(df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]), with_keys=True).cells
    if finite_only:
        cells = cells.filter(~F.col("cell").isin(*ENDLESS))
    sizes = {r["ord"]: r["n"] for r in cells.groupBy("ord").agg(F.sum("n").alias("n")).collect()}
    places = []
    for i, c in enumerate(columns):
        for p in probs:
            position = p * (sizes[i] - 1) if i in sizes else None
            places.append((i, c, float(p), position))
    ranks = sorted({(i, r) for i, _, _, at in places if at is not None for r in (int(at), min(int(at) + 1, sizes[i] - 1))})
    found = order_statistics(numeric_values(df, columns), cells, ranks)
    rows = []
    for i, c, p, at in places:
        value = None
        if at is not None:
            low, part = found[i, int(at)], at - int(at)
            high = found[i, min(int(at) + 1, sizes[i] - 1)]
            value = low if part == 0 or low == high else (1 - part) * low + part * high
        rows.append((i, c, p, value))
    return spark.createDataFrame(rows, "ord int, column string, prob double, value double")


def approximate_quantiles(
    df: DataFrame, columns: list[str], probs: tuple[float, ...] = QUARTILES, accuracy: int = 10_000
) -> DataFrame:
    """The same rows from one pass of ``percentile_approx``; off by up to n / accuracy ranks."""
    values = _values(df, columns)
    wanted = f"array({', '.join(sql_number(p) for p in probs)})"
    cells = df.agg(
        *[
            F.expr(f"percentile_approx({values[c]}, {wanted}, {accuracy}) AS q{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = ", ".join(
        f"named_struct('ord', {i}, 'column', {sql_text(c)}, 'prob', {sql_number(p)}, "
        f"'value', get(q{i}, {k}))"
        for i, c in enumerate(columns)
        for k, p in enumerate(probs)
    )
    return cells.selectExpr(f"inline(array({rows}))")
