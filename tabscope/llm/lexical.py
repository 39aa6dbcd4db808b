"""Exact ranked lexical search by a dual-tree walk.

Documents and items are both vectors over the items' terms: a document's
coordinates are its saturated term frequencies, an item's are its terms'
weights, and a score is their product. Trees over documents and over items hold
coordinate maxima, so that the product of two nodes bounds every score below
them. A pair of nodes is left out where the bound doesn't reach the weakest kth
score of the node's items.

Documents are stored once as vectors, some thousands to a row, and each such row
is a tree. The roots come first: for each item the most promising tree is scored,
and the kth scores found there open the walk over all trees.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import bound_arrow_batches
from tabscope.session import stage_table

TOP = 10
#: Items are searched for in blocks: a block's vocabulary and trees are told to all tasks.
BLOCK_ITEMS = 4096
BLOCK_BYTES = 4 << 20
#: Documents and vector entries of a stored row, at most (one document may have more entries).
TREE_DOCS = 4096
TREE_ENTRIES = 1 << 20
#: Documents and items of a leaf, and children of a node.
LEAF_DOCS, LEAF_ITEMS, FAN = 16, 8, 4
#: Cells of the matrix of leaf maxima; trees over wide vocabularies have fewer leaves.
CELLS = 1 << 22
#: Bytes of terms as they are, A-Z lower-cased, all others blanks.
TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and all beyond ASCII."""
    return text.translate(TERM_BYTES).split()


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of several ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Level:
    """Nodes of one level: node k holds ``[starts[k], starts[k + 1])`` of the level below (or of the items)."""

    starts: np.ndarray
    items: np.ndarray
    #: Terms and largest weights of all nodes, those of node k in ``[ends[k], ends[k + 1])``.
    terms: np.ndarray
    weights: np.ndarray
    ends: np.ndarray


class ItemTree:
    """Items in an order that puts those of equal rare terms together; ``levels`` from single items to the root."""

    def __init__(self, vectors: list[np.ndarray], weights: np.ndarray):
        rarest = [sorted(v.tolist(), key=lambda t: (-weights[t], t)) for v in vectors]
        self.order = sorted(range(len(vectors)), key=lambda k: rarest[k])
        sizes = np.array([len(vectors[k]) for k in self.order], dtype=np.int64)
        n = len(vectors)
        flat = np.concatenate([vectors[k] for k in self.order]).astype(np.int64)
        own = Level(np.arange(n + 1), np.arange(n + 1), flat, weights[flat], np.concatenate([[0], np.cumsum(sizes)]))
        self.levels = [own]
        step = LEAF_ITEMS
        while len(self.levels[-1].starts) > 2:
            low = self.levels[-1]
            count = len(low.starts) - 1
            starts = np.append(np.arange(0, count, step), count)
            step = FAN
            parts = [np.unique(low.terms[low.ends[a] : low.ends[b]]) for a, b in zip(starts, starts[1:], strict=False)]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            terms = np.concatenate(parts)
            # A term weighs the same in every item, so the largest weight is its own.
            self.levels.append(Level(starts, low.items[starts], terms, weights[terms], ends))


def products(level: Level, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Products of ``nodes`` with a dense vector, or with each row of a matrix."""
    at = runs(level.ends[nodes], level.ends[nodes + 1])
    sizes = level.ends[nodes + 1] - level.ends[nodes]
    return np.add.reduceat(dense[..., level.terms[at]] * level.weights[at], np.cumsum(sizes) - sizes, axis=-1)


class Best:
    """The k best documents of each item, and the score that a further one must reach."""

    def __init__(self, floor: np.ndarray, top: int):
        self.top, self.floor = top, floor.copy()
        self.found: list[list[tuple[int, bool, object]]] = [[] for _ in floor]

    def add(self, item: int, score: int, doc: object) -> None:
        rows = self.found[item]
        rows.append((-score, doc is not None, 0 if doc is None else doc))
        if len(rows) >= 4 * self.top:
            self.cut(item)

    def cut(self, item: int) -> None:
        rows = self.found[item]
        rows.sort()
        del rows[self.top :]
        if len(rows) == self.top:
            self.floor[item] = max(self.floor[item], -rows[-1][0])


@dataclass
class DocTree:
    """Documents of a stored row in an order that puts those of equal rare terms together."""

    docs: list[object]
    terms: np.ndarray
    parts: np.ndarray
    ends: np.ndarray
    #: Maxima by node, from the leaves to the root.
    levels: list[np.ndarray]

    def leaf(self, k: int, width: int) -> tuple[int, np.ndarray]:
        first, last = k * LEAF_DOCS, min((k + 1) * LEAF_DOCS, len(self.docs))
        dense = np.zeros((last - first, width))
        a, b = self.ends[first], self.ends[last]
        dense[np.repeat(np.arange(last - first), np.diff(self.ends[first : last + 1])), self.terms[a:b]] = self.parts[a:b]
        return first, dense


def doc_trees(row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[DocTree]:
    """Trees over a stored row's documents; more than one if the vocabulary is wide."""
    terms, tfs = np.asarray(row["terms"], dtype=np.int64), np.asarray(row["tfs"], dtype=np.int64)
    ends = np.concatenate([[0], np.asarray(row["ends"], dtype=np.int64)])
    sizes = np.diff(ends)
    m = 100 - 90 + (90 * np.asarray(row["lengths"], dtype=np.int64) * n_docs) // n_terms
    parts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))
    heaviest = np.maximum.reduceat(weights[terms].astype(np.int64) * (1 << 32) + terms, ends[:-1])
    order = np.lexsort((np.asarray(row["lengths"]), heaviest))
    width = len(weights)
    chunk = max(1, CELLS // width) * LEAF_DOCS
    for at in range(0, len(order), chunk):
        own = order[at : at + chunk]
        pick = runs(ends[own], ends[own + 1])
        own_ends = np.concatenate([[0], np.cumsum(sizes[own])])
        n_leaves = -(-len(own) // LEAF_DOCS)
        low = np.zeros((n_leaves, width))
        leaf_of = np.repeat(np.arange(len(own)) // LEAF_DOCS, sizes[own])
        np.maximum.at(low.ravel(), leaf_of * width + terms[pick], parts[pick].astype(np.float64))
        levels = [low]
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
        yield DocTree([row["docs"][k] for k in own.tolist()], terms[pick], parts[pick], own_ends, levels)


def search(tree: DocTree, items: ItemTree, best: Best) -> None:
    """Descends both trees at once, the more promising children first."""
    # Sums stay below 2^53, so that doubles hold them exactly.
    pending = [(len(tree.levels) - 1, 0, len(items.levels) - 1, np.zeros(1, dtype=np.int64))]
    while pending:
        height, node, depth, active = pending.pop()
        level = items.levels[depth]
        bounds = products(level, active, tree.levels[height][node])
        weakest = np.minimum.reduceat(best.floor, level.items[:-1])[active]
        active = active[(bounds >= weakest) & (bounds > 0)]
        if not len(active):
            continue
        if height == 0 and depth == 0:
            first, dense = tree.leaf(node, tree.levels[0].shape[1])
            scores = products(level, active, dense).astype(np.int64)
            for i, j in np.argwhere((scores >= best.floor[active]) & (scores > 0)).tolist():
                best.add(int(active[j]), int(scores[i, j]), tree.docs[first + i])
            for item in active[(scores >= best.floor[active]).any(axis=0)].tolist():
                best.cut(item)
            continue
        if depth:
            active = runs(level.starts[active], level.starts[active + 1])
            depth -= 1
        if height == 0:
            pending.append((0, node, depth, active))
            continue
        children = range(node * FAN, min((node + 1) * FAN, len(tree.levels[height - 1])))
        total = {c: float(tree.levels[height - 1][c].sum()) for c in children}
        pending += [(height - 1, c, depth, active) for c in sorted(children, key=total.__getitem__)]


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Stored rows: tree, docs, lengths, ends, terms, tfs of documents that hold a term; n_docs and n_terms of all."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    told = spark.sparkContext.broadcast(vocabulary)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, trees = told.value, TaskContext.get().partitionId(), 0
        docs, lengths, ends, terms, tfs = [], [], [], [], []
        n_docs = n_terms = 0
        ids = None

        def stored() -> pa.RecordBatch:
            nonlocal trees, n_docs, n_terms
            whole = lambda values, kind: pa.array([values], pa.list_(kind))
            row = [
                pa.array([(part << 32) + trees], pa.int64()), whole(docs, ids), whole(lengths, pa.int64()), whole(ends, pa.int64()),
                whole(terms, pa.int32()), whole(tfs, pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()),
            ]
            trees, n_docs, n_terms = trees + 1, 0, 0
            for x in (docs, lengths, ends, terms, tfs):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["tree", "docs", "lengths", "ends", "terms", "tfs", "n_docs", "n_terms"])

        for batch in batches:
            ids = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                if not counts:
                    continue
                docs.append(doc)
                lengths.append(len(words))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
                if len(docs) >= TREE_DOCS or len(terms) >= TREE_ENTRIES:
                    yield stored()
        if n_docs:
            yield stored()

    schema = (
        f"tree long, docs array<{kind}>, lengths array<long>, ends array<long>, terms array<int>, tfs array<int>"
        ", n_docs long, n_terms long"
    )
    return stage_table(narrow.mapInArrow(run, schema), "lexical")


def document_counts(indexed: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term; counted inside tasks, so that a task sends a row per term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    out = np.zeros(width, dtype=np.int64)
    for term, df in indexed.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, with ``rank``; first among shares of an item's rows, then among their winners."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    best = F.row_number().over(Window.partitionBy("item", salt).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return found.withColumn("rank", best).filter(F.col("rank") <= top).withColumn("rank", rank).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, texts: list[bytes], top: int, id_col: str, text_col: str) -> DataFrame | None:
    """item (place in ``texts``), rank, doc_id, score for one block of items; None if nothing can be found."""
    spark = docs.sparkSession
    words = [sorted(set(terms_of(t))) for t in texts]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*words)))}
    used = [k for k, w in enumerate(words) if w]
    if not used:
        return None
    indexed = index(docs, vocabulary, id_col, text_col)
    n_docs, n_terms = indexed.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    indexed = indexed.filter(F.size("docs") > 0)
    width = len(vocabulary)
    df = document_counts(indexed, width)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.float64)
    items = ItemTree([np.array([vocabulary[t] for t in words[k]]) for k in used], weights)
    told = spark.sparkContext.broadcast((items, weights))
    kind = indexed.schema["docs"].dataType.elementType.simpleString()
    columns = ["tree", "docs", "lengths", "ends", "terms", "tfs"]

    def promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = told.value
        single = items.levels[0]
        every = np.arange(len(items.order))
        most, where = np.full(len(every), -1.0), np.zeros(len(every), dtype=np.int64)
        for batch in batches:
            for row in rows_of(batch):
                for tree in doc_trees(row, weights, n_docs, n_terms):
                    bounds = products(single, every, tree.levels[-1][0])
                    where = np.where(bounds > most, row["tree"], where)
                    most = np.maximum(bounds, most)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(most), pa.array(where)], ["item", "bound", "tree"])

    def scored(floor: np.ndarray):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weights = told.value
            best, ids = Best(floor, top), None
            for batch in batches:
                ids = batch.schema.field("docs").type.value_type
                for row in rows_of(batch):
                    for tree in doc_trees(row, weights, n_docs, n_terms):
                        search(tree, items, best)
            out = []
            for place, item in enumerate(items.order):
                best.cut(place)
                out += [(item, doc if real else None, -score) for score, real, doc in best.found[place]]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), ids, pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

        return run

    schema = f"item long, doc_id {kind}, score long"
    first = indexed.select(*columns).mapInArrow(promising, "item long, bound double, tree long")
    seeds = first.groupBy("item").agg(F.max(F.struct("bound", "tree"))["tree"].alias("tree")).select("tree").distinct()
    opening = indexed.select(*columns).join(F.broadcast(seeds), "tree", "left_semi").mapInArrow(scored(np.zeros(len(used))), schema)
    kth = dict(ranked(opening, top).filter(F.col("rank") == top).select("item", "score").collect())
    floor = np.array([kth.get(k, 0) for k in items.order], dtype=np.float64)
    whole = ranked(indexed.select(*columns).mapInArrow(scored(floor), schema), top)
    back = F.element_at(F.lit(np.array(used, dtype=np.int64)), (F.col("item") + 1).cast("int"))
    return whole.select(back.alias("item"), "rank", "doc_id", "score")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; numbers as arrays, document ids as a list."""
    names = batch.schema.names
    for k in range(batch.num_rows):
        values = {c: batch.column(i)[k] for i, c in enumerate(names)}
        yield {
            c: v.as_py() if c == "tree" else v.values.to_pylist() if c == "docs" else v.values.to_numpy() for c, v in values.items()
        }


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Columns item_id, rank, doc_id, score: each item's best documents, ties by id (null first).

    An item is its id and text: equal rows are one item, other texts of one id
    are ranked on their own, and null or empty texts find nothing. Every row of
    the documents is a document, also where rows repeat; null and empty texts
    have no terms. Empty tables give no rows; further columns are left alone.
    Items go through in blocks, each with one pass over the texts.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    count, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    kind, doc_kind = own.schema["item_id"].dataType, docs.schema[id_col].dataType
    found = []
    for block in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
        result = search_block(docs, [r["text"].encode() for r in rows], top, id_col, text_col) if rows else None
        if result is not None:
            names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
            found.append(result.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
