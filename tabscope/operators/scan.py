"""One pass over a table for all that its columns' profile needs.

A task keeps one state whatever it reads: counts, extremes and moments of every
column, moments of every pair, and how many values have the same 16 leading bits
in an order that agrees with that of the numbers. The states of all tasks are
merged in two steps, the leading bits as sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.numeric import is_numeric, known_sql, quoted
from tabscope.operators.correlation import BLOCK_ROWS, MOMENTS, block_moments, merged_moments
from tabscope.session import stage_table

#: Numeric columns of one pass; each takes half a megabyte for its leading bits.
SCAN_COLUMNS = 128
BITS = 16
CELLS = 1 << BITS
SIGN = np.uint64(1 << 63)
#: Per column: the number of rows with a value, of finite ones and of plus infinity, extremes and moments of finite ones, bytes.
NUMBERS = ("n_known", "n_finite", "n_plus_inf", "fin_min", "fin_max", "mean", "dev", "octets")


def order_keys(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & SIGN, keys ^ SIGN, ~keys).view(np.float64)


def leading(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


#: Leading bits that only infinities have.
ENDLESS = tuple(int(x) for x in leading(order_keys(np.array([-np.inf, np.inf])), BITS))


@dataclass
class State:
    """Of all columns in schema order; ``only`` is a column's single value as text, None where there are none or several."""

    rows: int
    numbers: np.ndarray
    only: list[str | None]
    pairs: np.ndarray


def empty_state(n_columns: int, n_pairs: int) -> State:
    numbers = np.zeros((len(NUMBERS), n_columns))
    numbers[3], numbers[4] = np.inf, -np.inf
    return State(0, numbers, [None] * n_columns, np.zeros((len(MOMENTS), n_pairs)))


def merged(a: State, b: State) -> State:
    """Both states together."""
    x, y = a.numbers, b.numbers
    out = x + y
    out[3], out[4] = np.minimum(x[3], y[3]), np.maximum(x[4], y[4])
    n = x[1] + y[1]
    part = np.divide(y[1], n, out=np.zeros_like(n), where=n > 0)
    step = np.where((x[1] > 0) & (y[1] > 0), y[5] - x[5], 0.0)
    out[5] = np.where(x[1] == 0, y[5], x[5] + step * part)
    out[6] = x[6] + y[6] + x[1] * part * step * step
    only = [
        u if v_n == 0 else v if u_n == 0 else u if u == v else None
        for u, v, u_n, v_n in zip(a.only, b.only, x[0].tolist(), y[0].tolist(), strict=True)
    ]
    pairs = merged_moments(a.pairs, b.pairs) if a.pairs.size else a.pairs
    return State(a.rows + b.rows, out, only, pairs)


def block_state(z: np.ndarray, known: np.ndarray, with_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and pair moments of some rows of numeric columns."""
    rows, k = z.shape
    fin = np.isfinite(z)
    n = fin.sum(axis=0)
    start = np.where(n > 0, z[fin.argmax(axis=0), np.arange(k)], 0.0)
    with np.errstate(invalid="ignore"):
        d = np.where(fin, z - start, 0.0)
        low, high = np.where(fin, z, np.inf).min(axis=0), np.where(fin, z, -np.inf).max(axis=0)
    step = np.divide(d.sum(axis=0), n, out=np.zeros(k), where=n > 0)
    d = np.where(fin, d - step, 0.0)
    numbers = np.array([known.sum(axis=0), n, np.isposinf(z).sum(axis=0), low, high, start + step, (d * d).sum(axis=0), np.full(k, 8 * rows)])
    pairs = block_moments(np.where(fin, z, np.nan)) if with_pairs else np.zeros((len(MOMENTS), 0))
    return numbers, pairs


def state_schema(with_keys: bool) -> str:
    lists = [f"{c} array<double>" for c in (*NUMBERS, *MOMENTS)]
    keys = ["ords array<int>", "cells array<int>", "ns array<long>"] if with_keys else []
    return ", ".join(["n_rows long", "only array<string>", *lists, *keys])


def state_batch(state: State, keys: list[np.ndarray] | None) -> pa.RecordBatch:
    arrays = [pa.array([state.rows], pa.int64()), pa.array([state.only], pa.list_(pa.string()))]
    arrays += [pa.array([x], pa.list_(pa.float64())) for x in (*state.numbers, *state.pairs)]
    names = ["n_rows", "only", *NUMBERS, *MOMENTS]
    if keys is not None:
        arrays += [pa.array([x], pa.list_(t)) for x, t in zip(keys, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        names += ["ords", "cells", "ns"]
    return pa.RecordBatch.from_arrays(arrays, names)


def merge_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: State | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
            lists = lambda names: np.array([row[c].values.to_numpy(zero_copy_only=False) for c in names])  # noqa: B023, E731
            state = State(row["n_rows"].as_py(), lists(NUMBERS), row["only"].as_py(), lists(MOMENTS))
            total = state if total is None else merged(total, state)
    if total is not None:
        yield state_batch(total, None)


def scan_states(df: DataFrame, fields: list[T.StructField], with_pairs: bool, with_keys: bool) -> DataFrame:
    """One row per task: its state, and its non-zero counts of leading bits by column."""
    numeric = [i for i, f in enumerate(fields) if is_numeric(f.dataType)]
    texts = [i for i, f in enumerate(fields) if not is_numeric(f.dataType)]
    picked = [
        known_sql(f.name, f.dataType) if is_numeric(f.dataType) else f"CAST({quoted(f.name)} AS STRING)" for f in fields
    ]
    n_pairs = len(numeric) * (len(numeric) - 1) // 2 if with_pairs else 0

    def single(column: pa.Array) -> str | None:
        ends = pc.min_max(column)
        low, high = ends["min"], ends["max"]
        if not low.is_valid or low != high:
            return None
        # Both zeros are one value.
        return str(low.as_py() + 0.0 if pa.types.is_floating(column.type) else low.as_py())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty_state(len(fields), n_pairs)
        cells = np.zeros((len(numeric) if with_keys else 0, CELLS), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = empty_state(len(fields), n_pairs)
            own.rows = batch.num_rows
            own.only = [single(c) for c in batch.columns]
            for i in texts:
                c = batch.column(i)
                own.numbers[0, i] = batch.num_rows - c.null_count
                own.numbers[7, i] = pc.sum(pc.binary_length(c)).as_py() or 0
            z = np.empty((batch.num_rows, len(numeric)))
            known = np.empty(z.shape, dtype=bool)
            for j, i in enumerate(numeric):
                c = batch.column(i)
                if not pa.types.is_floating(c.type):
                    c = c.cast(pa.float64(), safe=False)
                z[:, j] = c.to_numpy(zero_copy_only=False)
                known[:, j] = ~np.isnan(z[:, j])
                if with_keys:
                    cells[j] += np.bincount(leading(order_keys(z[known[:, j], j]), BITS), minlength=CELLS)
            part = None
            for first in range(0, batch.num_rows if numeric else 0, BLOCK_ROWS):
                at = slice(first, first + BLOCK_ROWS)
                numbers, pairs = block_state(z[at], known[at], with_pairs)
                new = State(0, numbers, [None] * len(numeric), pairs)
                part = new if part is None else merged(part, new)
            if part is not None:
                own.numbers[:, numeric] = part.numbers
                own.pairs = part.pairs
            total = merged(total, own)
        at = np.nonzero(cells)
        yield state_batch(total, [at[0].astype(np.int32), at[1].astype(np.int32), cells[at]] if with_keys else None)

    return df.selectExpr(*[f"{e} AS v{i}" for i, e in enumerate(picked)]).mapInArrow(run, state_schema(with_keys))


@dataclass(frozen=True)
class Scan:
    """What one pass has found. ``cells``: ord (place among the numeric columns), cell, n."""

    fields: list[T.StructField]
    state: DataFrame
    cells: DataFrame | None

    @property
    def numeric(self) -> list[int]:
        return [i for i, f in enumerate(self.fields) if is_numeric(f.dataType)]

    def measures(self) -> DataFrame:
        """One row per column: ord, column, dtype, numeric, n_rows, the counts, extremes, mean and sample variance."""
        place = F.col("i")
        at = lambda c: F.get(c, place)
        names = F.array(*[F.lit(f.name) for f in self.fields])
        kinds = F.array(*[F.lit(f.dataType.simpleString()) for f in self.fields])
        flags = F.array(*[F.lit(is_numeric(f.dataType)) for f in self.fields])
        rows = self.state.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(self.fields) - 1))).alias("i"))
        some = at("n_finite") > 0
        count = lambda c: at(c).cast("long").alias(c)
        return rows.select(
            place.alias("ord"),
            F.get(names, place).alias("column"),
            F.get(kinds, place).alias("dtype"),
            F.get(flags, place).alias("numeric"),
            "n_rows",
            count("n_known"),
            count("n_finite"),
            count("n_plus_inf"),
            F.when(some, at("fin_min")).alias("fin_min"),
            F.when(some, at("fin_max")).alias("fin_max"),
            F.when(some, at("mean")).alias("fin_mean"),
            F.when(at("n_finite") > 1, at("dev") / (at("n_finite") - 1)).alias("fin_var"),
            ((at("n_known") == 0) | at("only").isNotNull()).alias("one_value"),
            count("octets"),
        )

    def pair_moments(self) -> DataFrame:
        """a, b and the moments of each pair of numeric columns."""
        upper = np.triu_indices(len(self.numeric), 1)
        ends: list[Column] = [F.split(F.lit(",".join(map(str, u))), ",").cast("array<int>") for u in upper]
        named = self.state.select(ends[0].alias("a"), ends[1].alias("b"), *MOMENTS)
        return named.select(F.inline(F.arrays_zip("a", "b", *MOMENTS)))


def scan_table(df: DataFrame, columns: list[str] | None = None, *, with_pairs: bool = False, with_keys: bool = False) -> Scan:
    """Read the table once; more than ``SCAN_COLUMNS`` numeric columns don't fit one pass with leading bits."""
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    if not fields:
        raise ValueError("no columns to profile")
    if with_keys and sum(is_numeric(f.dataType) for f in fields) > SCAN_COLUMNS:
        raise ValueError(f"one pass counts the leading bits of at most {SCAN_COLUMNS} columns")
    # A table without partitions has no task that would say so.
    n_numeric = sum(is_numeric(f.dataType) for f in fields)
    n_pairs = n_numeric * (n_numeric - 1) // 2 if with_pairs else 0
    none = state_batch(empty_state(len(fields), n_pairs), [np.zeros(0, int)] * 3 if with_keys else None)
    first = df.sparkSession.createDataFrame(pa.Table.from_batches([none]), state_schema(with_keys))
    states = stage_table(scan_states(df, fields, with_pairs, with_keys).unionByName(first), "scan-states")
    kept = ["n_rows", "only", *NUMBERS, *MOMENTS]
    state = states.select(*kept)
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in dict.fromkeys((groups, 1)):
        state = state.repartition(n).mapInArrow(merge_states, state_schema(False))
    cells = None
    if with_keys:
        zipped = states.select(F.inline(F.arrays_zip("ords", "cells", "ns")))
        cells = zipped.toDF("ord", "cell", "n").groupBy("ord", "cell").agg(F.sum("n").alias("n"))
    return Scan(fields, state, cells)


def numeric_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles v0, v1, ..., NULL where missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.selectExpr(*[f"CAST({known_sql(c, types[c])} AS DOUBLE) AS v{i}" for i, c in enumerate(columns)])

