"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted in the
inverted files of the first of them. A query reads the files of its own first
pivots, ranks what it finds by the footrule distance of the two orders, and
computes the inner product for the best of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import literal_array
from tabscope.session import stage_table


@dataclass(frozen=True)
class IndexShape:
    """Pivots grow with the root of the vectors within fixed bounds, and files and reranked rows grow with the pivots.

    At least ``order`` pivots represent a vector, and it is posted with the first
    ``files`` of the least number of pivots and with more as their fourth root
    grows. Of all it reads, a query reranks by footrule as many rows as ``rerank``
    files hold, and of each block at least ``rerank_top`` for every row asked for.
    """

    pivots_per_root: float = 1.0
    least_pivots: int = 64
    most_pivots: int = 4096
    order: int = 64
    files: int = 16
    block: int = 8192
    query_block: int = 1024
    rerank: float = 7.0
    rerank_top: int = 8

    def pivots(self, n: int) -> int:
        return min(self.most_pivots, max(self.least_pivots, round(self.pivots_per_root * n**0.5)))

    def files_of(self, n_pivots: int) -> int:
        return min(n_pivots, round(self.files * max(1.0, n_pivots / self.least_pivots) ** 0.25))

    def reranked(self, rows: int, files: int, top: int) -> int:
        """Rows with an exact score of so many in a block."""
        return min(rows, max(self.rerank_top * top, math.ceil(self.rerank / max(files, 1) * rows)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec, h1, h2: vectors that take part, with two hashes of their numbers.

    Null ids, null or zero vectors and such with null or non-finite numbers are
    left out. Vectors of different lengths are an error, as they have no product.
    """
    vec = F.col(vec_col)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.filter(F.col(id_col).isNotNull() & vec.isNotNull() & ~odd & F.exists(vec, lambda x: x != 0))
    # Adding zero makes -0.0 and 0.0 one number.
    good = good.select(F.col(id_col).alias("vec_id"), F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    shortest, longest = good.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if shortest != longest:
        raise ValueError(f"the vectors have {shortest} to {longest} numbers; all need the same")
    return good.withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")})


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first.

    One more coordinate gives all vectors the same length, so that the largest
    inner product and the least distance are the same; a query has zero there.
    """
    near = np.hstack([x, extra[:, None]]) @ pivots.T
    part = np.argpartition(-near, order - 1, axis=1)[:, :order]
    inner = np.take_along_axis(near, part, axis=1)
    return np.take_along_axis(part, np.lexsort((part, -inner), axis=1), axis=1).astype(np.int32)


def place_codes(near: np.ndarray, n_pivots: int) -> np.ndarray:
    """Orders as bitmaps: for each pivot, whether it stands among the first 1, 2, 4, ... of the order."""
    k = near.shape[1]
    place = np.full((len(near), n_pivots), k, dtype=np.int32)
    np.put_along_axis(place, near, np.arange(k, dtype=np.int32)[None, :].repeat(len(near), axis=0), axis=1)
    width = -(-n_pivots // 64) * 64
    codes = []
    first = 1
    while first <= k:
        bits = np.zeros((len(near), width), dtype=bool)
        bits[:, :n_pivots] = place < first
        codes.append(np.packbits(bits, axis=1).view(np.uint64))
        first *= 2
    return np.hstack(codes)


def footrule(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Footrule distance of one coded order to others: the sum of how far each pivot's place moves.

    Places are told apart in classes that double, and a pivot outside an order
    stands in the class after the last.
    """
    return np.bitwise_count(others ^ query).sum(axis=1, dtype=np.int64)


def nearest_rows(distance: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The rows of the ``most`` smallest distances; of equal ones at the end those of the smallest ids, in whatever order rows came."""
    last = np.partition(distance, most - 1)[most - 1]
    sure, tied = np.flatnonzero(distance < last), np.flatnonzero(distance == last)
    return np.concatenate([sure, tied[np.argsort(ids[tied], kind="stable")[: most - len(sure)]]])


def searched(
    postings: DataFrame, asked: DataFrame, kind: str, width: int, n_pivots: int, top: int, reranked: Callable[[int], int]
) -> DataFrame:
    """q, c, score: the ``top`` best classes of each posting block for each query that reads it.

    Both sides carry file, block (of the postings) and qblock (of the queries), so
    that a group holds at most one block of either, however full a file is.
    ``reranked`` tells how many of a block's rows get an exact score.
    """

    def vectors_of(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["raw"].to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)

    def codes_of(t: pa.Table) -> np.ndarray:
        near = np.frombuffer(b"".join(t["near"].to_pylist()), dtype="<i2").reshape(t.num_rows, -1)
        return place_codes(near.astype(np.int64), n_pivots)

    def search(_: object, found: pa.Table, wanted: pa.Table) -> pa.Table:
        qs, cs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        if found.num_rows and wanted.num_rows:
            x, y, ids = vectors_of(found), vectors_of(wanted), found["cls"].to_numpy()
            x_code, y_code = codes_of(found), codes_of(wanted)
            most = reranked(len(ids))
            for i, q in enumerate(wanted["cls"].to_pylist()):
                rows = np.arange(len(ids))
                if most < len(ids):
                    rows = nearest_rows(footrule(y_code[i], x_code), ids, most)
                score = (x[rows] * y[i]).sum(axis=1)
                if top < len(rows):
                    # Ties at the end of the list are all kept for the order by id.
                    keep = score >= np.partition(score, len(score) - top)[len(score) - top]
                    rows, score = rows[keep], score[keep]
                best = np.lexsort((ids[rows], -score))[:top]
                qs += [q] * len(best)
                cs.append(ids[rows][best])
                scores.append(score[best])
        return pa.table({"q": pa.array(qs, pa.int64()), "c": np.concatenate(cs), "score": np.concatenate(scores)})

    keys = ("file", "block", "qblock")
    return postings.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "q long, c long, score double")


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    shape: IndexShape = IndexShape(),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``, against all other rows.

    Equal vectors form a class that is indexed and searched once; of its rows,
    the k + 1 with the smallest ids can be among the nearest, so the others are
    only asked for, never offered. Ties go to the smaller id. Repeated rows count
    once. Queries that find fewer than k rows read all blocks. Vectors that take
    no part (see ``usable``) neither ask nor answer; no vectors give no rows.
    """
    rows = stage_table(usable(vectors, id_col, vec_col), "ann-rows")
    narrow = rows.select("vec_id", "h1", "h2").distinct()
    groups = narrow.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("cls"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")
    )
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    offered = (
        narrow.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("c"), F.collect_list("vec_id").alias("ids"))
        .select("c", "ids")
    )
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    classes = stage_table(
        groups.join(rows.select("vec_id", "vec").dropDuplicates(["vec_id"]), F.col("cls") == F.col("vec_id"))
        .select("cls", "h1", "h2", "asks", "vec", length.alias("len2")),
        "ann-classes",
    )
    n, longest = classes.agg(F.count("*"), F.max("len2")).first()
    n_pivots = min(n, shape.pivots(n))
    files = shape.files_of(n_pivots)
    order = min(max(shape.order, files), n_pivots)
    # A bounded number of vectors, the first by a hash: the pivots.
    chosen = classes.orderBy(F.xxhash64("h1", "h2"), "cls").limit(n_pivots).select("vec", "len2").collect()
    width = len(chosen[0]["vec"]) if chosen else 1
    room = lambda len2: np.sqrt(np.maximum(0.0, (longest or 0.0) - np.asarray(len2, dtype=float)))
    pivots = np.array([r["vec"] for r in chosen]).reshape(-1, width)
    pivots = np.hstack([pivots, room([r["len2"] for r in chosen])[:, None]])

    element = vectors.schema[vec_col].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"

    def orders(as_query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(1), width)
                extra = np.zeros(len(x)) if as_query else room(batch.column(2).to_numpy())
                near = nearest_pivots(x, extra, pivots, order).astype("<i2")
                first = pa.array(list(near[:, :files].astype(np.int32)), pa.list_(pa.int32()))
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), raw, pa.array([v.tobytes() for v in near], pa.binary()), first],
                    ["cls", "raw", "near", "files"],
                )

        return run

    schema = "cls long, raw binary, near binary, files array<int>"
    columns = ("cls", "vec", "len2")
    indexed = stage_table(classes.select(*columns).mapInArrow(orders(False), schema), "ann-index")
    asking = stage_table(classes.filter("asks = 1").select(*columns).mapInArrow(orders(True), schema), "ann-queries")

    def blocks_of(frame: DataFrame, rows: int) -> list[int]:
        """Blocks of each file, from the counts of at most ``most_pivots`` files."""
        counts = {r["file"]: r["count"] for r in frame.select(F.explode("files").alias("file")).groupBy("file").count().collect()}
        return [-(-counts.get(p, 0) // rows) or 1 for p in range(n_pivots)]

    file = lambda frame: frame.select("cls", "raw", "near", F.explode("files").alias("file"))
    at = lambda blocks: F.element_at(literal_array(blocks or [1], "int"), F.col("file") + 1)
    own = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks, qblocks = blocks_of(indexed, shape.block), blocks_of(asking, shape.query_block)
    postings = file(indexed).withColumn("block", own(at(blocks))).withColumn("qblock", all_of(at(qblocks)))
    asked = file(asking).withColumn("qblock", own(at(qblocks))).withColumn("block", all_of(at(blocks)))
    hits = searched(postings, asked, kind, width, n_pivots, k + 1, lambda rows: shape.reranked(rows, files, k + 1))
    best = stage_table(best_rows(hits, offered, k), "ann-best")
    wanted = min(k + 1, narrow.count())
    short = stage_table(asking.join(best.filter(F.size("found") >= wanted), F.col("cls") == F.col("q"), "left_anti"), "ann-short")
    if short.limit(1).count():
        # All blocks of all vectors, for those queries alone.
        n_blocks, n_short = F.lit(-(-n // shape.block)), F.lit(-(-short.count() // shape.query_block))
        every_file = indexed.drop("files").withColumn("file", F.lit(-1)).withColumn("block", own(n_blocks)).withColumn("qblock", all_of(n_short))
        all_files = short.drop("files").withColumn("file", F.lit(-1)).withColumn("qblock", own(n_short)).withColumn("block", all_of(n_blocks))
        exact = searched(every_file, all_files, kind, width, n_pivots, k + 1, lambda rows: rows)
        rest = best.join(short, F.col("cls") == F.col("q"), "left_anti")
        best = rest.unionByName(best_rows(exact, offered, k))
    queries = narrow.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    named = queries.join(groups.filter("asks = 1").select("h1", "h2", F.col("cls").alias("q")), ["h1", "h2"])
    lists = named.join(best, "q").select(
        "query_id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("found")
    )
    return lists.select("query_id", F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )


def best_rows(hits: DataFrame, offered: DataFrame, k: int) -> DataFrame:
    """q, found: for each query class the k + 1 nearest rows, nearest first, as array of (vec_id, score)."""
    place = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    classes = hits.groupBy("q", "c").agg(F.max("score").alias("score"))
    top = classes.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1)
    rows = top.join(offered, "c").select("q", "score", F.explode("ids").alias("vec_id"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")))
    return rows.groupBy("q").agg(
        F.transform(F.slice(ordered, 1, k + 1), lambda x: F.struct(x.vec_id.alias("vec_id"), x.score.alias("score"))).alias("found")
    )
