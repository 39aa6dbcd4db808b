"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. What a line and its two neighbours look
like gives the odds of the line, transitions join it to the next one, and
forward-backward gives each line's marginal. A document's quality is the mean of
its lines' marginals, weighted by their lengths.

Labels are known for documents only. Training starts with every line labelled
like its document; then lines of bad documents that the model finds good change
sides, and it is trained once more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import bound_arrow_batches

#: Labelled documents of each class that train the model, at most, and lines that such a document may have.
TRAIN_DOCS = 2000
TRAIN_LINES = 2000
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
ACCEPT = 0.7
#: The remainder of an id's checksum by 4 that is kept out of training.
HELD_OUT = 2

SYMBOLS = b"#*$%&|<>!@^_~=+{}[]\\/`"
STOPS = b".,;:?"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SHARES = (0.0005, 0.005, 0.015, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5)
#: What is measured of a line, with the edges that cut it into classes.
MEASURES: dict[str, tuple[float, ...]] = {
    "bytes": (1, 4, 16, 64, 256, 1024, 4096),
    "words": (1, 2, 5, 10, 20, 50, 100, 300),
    "word_bytes": (2, 3, 4, 5, 6, 7, 8, 10, 14, 20),
    "symbols": SHARES,
    "stops": SHARES,
    "upper": SHARES,
    "digits": SHARES,
    "distinct": (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.99),
    "twins": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "repeats": (0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "seen": (0.5,),
}
OFFSETS = np.cumsum([0, *(len(e) + 1 for e in MEASURES.values())])
#: Classes of one line; a neighbour's follow, one more class says that there is none.
OWN = int(OFFSETS[-1])
WIDTH = 3 * OWN + 2


def measured(text: bytes) -> list[tuple[float, ...]]:
    """One row of measures for each line; three-word runs repeat if the text had them before, in this line or another."""
    out = []
    lines: set[bytes] = set()
    triples: set[tuple[bytes, bytes, bytes]] = set()
    for line in text.split(b"\n"):
        size, words = len(line), line.split()
        n = len(words)
        runs = set(zip(words, words[1:], words[2:], strict=False))
        runs -= triples
        triples |= runs
        lacking = lambda kind: (size - len(line.translate(None, kind))) / max(1, size)  # noqa: B023, E731
        out.append(
            (
                size, n, sum(map(len, words)) / max(1, n), lacking(SYMBOLS), lacking(STOPS), lacking(UPPER), lacking(DIGITS),
                len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), 1 - len(runs) / max(1, n - 2) if n > 2 else 0.0, float(n > 0 and line in lines),
            )
        )
        lines.add(line)
    return out


@dataclass
class Lines:
    """Lines of several documents: ``classes`` by line, ``sizes`` in bytes, lines of document k in ``[ends[k], ends[k + 1])``."""

    classes: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray


def gather(texts: list[bytes]) -> Lines:
    """Classes of each line and of its neighbours."""
    rows = [measured(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    table = np.array([x for r in rows for x in r], dtype=np.float64).reshape(-1, len(MEASURES))
    own = np.empty(table.shape, dtype=np.int64)
    for k, edges in enumerate(MEASURES.values()):
        own[:, k] = OFFSETS[k] + np.searchsorted(edges, table[:, k], side="right")
    first, last = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    first[ends[:-1]] = last[ends[1:] - 1] = True
    before = np.where(first[:, None], 3 * OWN, np.roll(own, 1, axis=0) + OWN)
    after = np.where(last[:, None], 3 * OWN + 1, np.roll(own, -1, axis=0) + 2 * OWN)
    return Lines(np.concatenate([own, before, after], axis=1), table[:, 0] + 1, ends)


@dataclass
class Field:
    """Weights towards good by class, and of the transitions between bad (0) and good (1)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def odds(self, lines: Lines) -> np.ndarray:
        return self.weights[lines.classes].sum(axis=1)


def forward_backward(odds: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good by line; and of each pair of labels by line and next line, zero behind a last line.

    All documents advance together, the longest first, so that a step works on those that are long enough.
    """
    counts = np.diff(ends)
    order = np.argsort(-counts, kind="stable")
    start, counts = ends[:-1][order], counts[order]
    emit = np.stack([np.zeros(len(odds)), odds], axis=1)
    ahead, back = emit.copy(), np.zeros((len(odds), 2))
    alive = [int(np.searchsorted(-counts, -t)) for t in range(int(counts[0]) if len(counts) else 0)]
    for t in range(1, len(alive)):
        at = start[: alive[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        later = back[at] + emit[at]
        back[at - 1] = np.logaddexp(later[:, :1] + moves[:, 0], later[:, 1:] + moves[:, 1])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((len(odds), 2, 2))
    inner = np.ones(len(odds), dtype=bool)
    inner[ends[1:] - 1] = False
    at = np.flatnonzero(inner)
    pairs[at] = np.exp(ahead[at][:, :, None] + moves + (emit + back)[at + 1][:, None, :] - total[at][:, None, None])
    return np.exp(both[:, 1] - total), pairs


def train(lines: Lines, labels: np.ndarray, model: Field) -> None:
    """Maximum likelihood of the lines' labels with a small ridge, by full-batch steps of adapted size."""
    flat = lines.classes.ravel()
    inner = np.ones(len(labels), dtype=bool)
    inner[lines.ends[1:] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    values = np.concatenate([model.weights, model.moves.ravel()])
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        good, pairs = forward_backward(model.odds(lines), lines.ends, model.moves)
        gap = np.repeat(labels - good, lines.classes.shape[1])
        slope = np.concatenate([np.bincount(flat, gap, minlength=WIDTH), (seen - pairs.sum(axis=0)).ravel()]) / len(labels)
        slope -= RIDGE * values
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        values = values + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        model.weights, model.moves = values[:WIDTH], values[WIDTH:].reshape(2, 2)


def fit(texts: list[bytes], good: list[int]) -> Field:
    """A model from whole texts and their documents' labels; without both classes every line has even odds."""
    model = Field()
    if len(set(good)) < 2:
        return model
    lines = gather(texts)
    labels = np.repeat(np.array(good, dtype=np.int64), np.diff(lines.ends))
    train(lines, labels, model)
    marginals, _ = forward_backward(model.odds(lines), lines.ends, model.moves)
    train(lines, np.maximum(labels, (marginals > 0.5).astype(np.int64)), model)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A model from the labelled documents that aren't held out: of each class those with the smallest hashes of their ids.

    Labels that are null, contradict each other or name no document train
    nothing. Of several texts under one id one trains.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("_most")).filter("good = _most").drop("_most")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("good") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Twice TRAIN_DOCS ids, whatever the tables.
    rows = texts.join(F.broadcast(chosen), "doc_id").filter(F.size(F.split(F.col("text").cast("string"), "\n")) <= TRAIN_LINES)
    one = rows.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").collect()
    return fit([bytes(r["text"]) for r in one], [r["good"] for r in one])


def line_quality(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, score, good (each line's marginal of being good).

    Rows pass through one by one, also with null or repeated ids; a null text is
    empty and, like an empty one, a single empty line. Further columns are left alone.
    """
    bound_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    narrow = docs.select(F.col(id_col).alias("doc_id"), text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = gather(batch.column(1).to_pylist())
            good, _ = forward_backward(model.odds(lines), lines.ends, model.moves)
            at = lines.ends[:-1]
            score = np.add.reduceat(good * lines.sizes, at) / np.add.reduceat(lines.sizes, at)
            each = pa.ListArray.from_arrays(pa.array(lines.ends, pa.int32()), pa.array(good))
            columns = [batch.column(0), pa.array(np.clip(score, 0, 1)), each]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "good"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double, good array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, score, predicted, by a model of the labelled documents that aren't held out."""
    scored = line_quality(docs, fit_quality(docs, labels))
    accepted = (F.col("score") >= ACCEPT).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", accepted.alias("predicted"))
