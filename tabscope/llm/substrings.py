"""Removal of repeated passages by prefix-partitioned suffix trees.

A window is so many consecutive words. Sampled positions of a text, which equal
windows choose alike, begin its suffixes. A suffix's prefix decides its group:
a short one, or all of a window where many suffixes share the short one. Each
group is a subtree that fits in memory; suffixes that meet in a node at least a
window deep repeat each other, and all but the earliest are marked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import bound_arrow_batches, broadcast_if_small, keyed_texts, same_key, shielded
from tabscope.llm.shingles import word_numbers, windows, words_of
from tabscope.session import stage_table


@dataclass(frozen=True)
class Passages:
    """Windows of ``window`` words; short prefixes of ``short`` words, deepened where over ``group`` suffixes share one."""

    window: int = 20
    short: int = 6
    group: int = 2000


#: So often one task sends a short prefix to be met; further places are known to repeat.
SENT = 4
#: A prefix met so often by one task, or ``Passages.group`` times over all, is deepened.
OFTEN = 128
#: A task forgets the prefixes it has met beyond so many, which costs bytes and changes nothing else.
MET = 500_000
HEAVY_ROWS = 500_000
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def chosen(numbers: np.ndarray, rule: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short prefixes, and for each window the position of the least one inside it.

    The leftmost of equal ones is taken, so equal windows choose alike.
    """
    short = windows(numbers, rule.short)
    span = rule.window - rule.short + 1
    if len(short) < span:
        return short, np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(short, span).argmin(axis=1)
    return short, least + np.arange(len(least))


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut so that no run of equal keys is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(key)[0].as_py() != keys[0]):
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def repeated_prefixes(keyed: DataFrame, rule: Passages) -> DataFrame:
    """kind, prefix, doc, at. Kinds 0 and 1: chosen positions whose short prefix occurs elsewhere too.

    Kind 2 names prefixes to deepen. ``doc`` is a hash of the document's key, so
    that rarely a position is named in vain.
    """

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            docs, ats, prefixes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short, least = chosen(word_numbers(words_of(text)), rule)
                at = np.unique(least)
                docs.append(np.full(len(at), doc, dtype=np.int64))
                ats.append(at)
                prefixes.append(short[at].view(np.int64))
            doc, at, prefix = (np.concatenate(x) for x in (docs, ats, prefixes))
            if len(met) > MET:
                met.clear()
            times = np.zeros(len(prefix), dtype=np.int64)
            for i, p in enumerate(prefix.tolist()):
                times[i] = met[p] = met.get(p, 0) + 1
            # What is known to repeat needs no meeting and goes anywhere.
            kind = (times > SENT).astype(np.int32)
            deal = np.where(kind == 1, doc + at * 0x9E3779B1, prefix)
            heavy = prefix[times == OFTEN]
            none = np.zeros(len(heavy), np.int64)
            columns = [(deal, heavy), (np.append(kind, none + 2).astype(np.int32),), (prefix, heavy), (doc, none), (at, none)]
            arrays = [pa.array(np.concatenate(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.int32())], ["deal", "kind", "prefix", "doc", "at"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "deal"):
            _, kind, prefix, doc, at = (c.to_numpy() for c in table.columns)
            new = kind == 0
            values, index, counts = np.unique(prefix[new], return_inverse=True, return_counts=True)
            keep = kind > 0
            keep[new] = counts[index] > 1
            heavy = values[counts >= rule.group]
            none = np.zeros(len(heavy), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(kind[keep], none + 2).astype(np.int32)),
                    pa.array(np.append(prefix[keep], heavy)),
                    pa.array(np.append(doc[keep], none)),
                    pa.array(np.append(at[keep], none).astype(np.int32)),
                ],
                ["kind", "prefix", "doc", "at"],
            )

    narrow = keyed.select(F.xxhash64("_id", "_th").alias("doc"), "_text")
    sent = narrow.mapInArrow(choose, "deal long, kind int, prefix long, doc long, at int")
    dealt = sent.repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(meet, "kind int, prefix long, doc long, at int")


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def as_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def first_and_rest(h: np.ndarray, ids: np.ndarray, ths: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and which of them in that order repeat the earliest of their node.

    Sorted suffixes with equal window hashes meet in a node a window deep. The
    same place of repeated rows isn't a repeat of itself.
    """
    order = np.lexsort((ats, ths, ids, h))
    h, place = h[order], np.stack([ids[order], ths[order], ats[order]])
    start = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    return order, (place != place[:, lead]).any(axis=0)


def grouped(ids: np.ndarray, ths: np.ndarray, ats: np.ndarray) -> list[pa.Array]:
    """One row (_id, _th, ats) per document."""
    order = np.lexsort((ats, ths, ids))
    ids, ths, ats = ids[order], ths[order], ats[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ats, pa.int32()))
    return [as_ids(ids[at]), pa.array(ths[at]), lists]


def repeats(keyed: DataFrame, rule: Passages) -> DataFrame:
    """_id, _th, ats: per document the starts of windows that also start earlier."""
    found = stage_table(repeated_prefixes(keyed, rule), "repeat-prefixes")
    places = found.filter("kind < 2").groupBy("doc").agg(F.collect_list("at").alias("places"))
    heavy = stage_table(found.filter("kind = 2").select("prefix").distinct().withColumn("deep", F.lit(True)), "repeat-heavy")
    asked = keyed.withColumn("doc", F.xxhash64("_id", "_th")).join(places, "doc").select("_id", "_th", "_text", "places")

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows whose chosen position repeats. Of equal ones in a batch the earliest goes on, the others are marked."""
        for batch in batches:
            ids, ths = ids_of(batch.column(0)), batch.column(1).to_numpy()
            parts = []
            for k, (text, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                numbers = word_numbers(words_of(text))
                short, least = chosen(numbers, rule)
                wanted = np.zeros(len(short) + 1, dtype=bool)
                wanted[[p for p in places if p < len(short)]] = True
                at = np.flatnonzero(wanted[least])
                h = windows(numbers, rule.window)[at].view(np.int64)
                parts.append((h, short[least[at]].view(np.int64), np.full(len(at), k), at))
            if not parts:
                continue
            h, prefix, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, later = first_and_rest(h, ids[doc], ths[doc], at)
            lost = order[later]
            marked = grouped(ids[doc[lost]], ths[doc[lost]], at[lost])
            first = order[~later]
            # The suffixes of one document and chosen position travel together.
            first = first[np.lexsort((at[first], prefix[first], doc[first]))]
            d, p = doc[first], prefix[first]
            new = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])) if len(d) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            offsets = pa.array(np.append(begin, len(first)), pa.int32())
            n = len(marked[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(p[begin], np.zeros(n, np.int64))),
                    pa.concat_arrays([as_ids(ids[d[begin]]), marked[0]]),
                    pa.array(np.append(ths[d[begin]], marked[1].to_numpy())),
                    pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(at[first], pa.int32())), marked[2]]),
                    pa.concat_arrays(
                        [pa.ListArray.from_arrays(offsets, pa.array(h[first])), pa.array([[]] * n, pa.list_(pa.int64()))]
                    ),
                ],
                ["prefix", "_id", "_th", "ats", "hs"],
            )

    def subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by deal: whole groups, in which equal suffixes are adjacent once sorted."""
        for table in whole_runs(batches, "deal"):
            ids, ths = ids_of(table["_id"]), table["_th"].to_numpy()
            sizes = np.diff(table["ats"].combine_chunks().offsets.to_numpy()) if table.num_rows else np.zeros(0, int)
            rows = np.repeat(np.arange(table.num_rows), sizes)
            ats = table["ats"].combine_chunks().flatten().to_numpy()
            n_hash = np.array([len(x) for x in table["hs"]]) if table.num_rows else np.zeros(0, int)
            suffix = np.repeat(n_hash > 0, sizes)
            h = table["hs"].combine_chunks().flatten().to_numpy()
            order, later = first_and_rest(h, ids[rows[suffix]], ths[rows[suffix]], ats[suffix])
            lost = np.append(np.flatnonzero(suffix)[order[later]], np.flatnonzero(~suffix))
            if len(lost):
                yield pa.RecordBatch.from_arrays(grouped(ids[rows[lost]], ths[rows[lost]], ats[lost]), ["_id", "_th", "ats"])

    sent = asked.mapInArrow(suffixes, "prefix long, _id long, _th long, ats array<int>, hs array<long>")
    marked = F.size("hs") == 0
    deepened = F.transform(
        F.sequence(F.lit(1), F.size("hs")),
        lambda i: F.struct(F.array(F.element_at("ats", i)).alias("ats"), F.array(F.element_at("hs", i)).alias("hs")),
    )
    whole = F.array(F.struct("ats", "hs"))
    dealt = (
        sent.join(broadcast_if_small(heavy, HEAVY_ROWS), "prefix", "left")
        .withColumn("part", F.explode(F.when(F.col("deep").isNull() | marked, whole).otherwise(deepened)))
        .select(
            F.when(marked, F.xxhash64("_th", "_id", F.element_at("ats", 1)))
            .when(F.col("deep").isNull(), F.col("prefix"))
            .otherwise(F.element_at("part.hs", 1))
            .alias("deal"),
            "_id",
            "_th",
            "part.ats",
            "part.hs",
        )
    )
    sorted_rows = dealt.repartition("deal").sortWithinPartitions("deal")
    later = sorted_rows.mapInArrow(subtrees, "_id long, _th long, ats array<int>")
    return later.groupBy("_id", "_th").agg(F.flatten(F.collect_list("ats")).alias("ats"))


def covered(n: int, ats: list[int] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``ats``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if ats:
        starts = np.unique(np.array(ats))
        edge[starts] += 1
        np.subtract.at(edge, starts + window, 1)
    return np.cumsum(edge[:n]) > 0


def passage_report(docs: DataFrame, rule: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as text.

    A null text has no words. Whole-number ids order the documents, null ids come
    last, and documents of one id go by their text's hash. Repeated rows count as
    one document, and each gets its row. No rows give none.
    """
    bound_arrow_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    later = repeats(keyed, rule)
    both = keyed.join(later, same_key(keyed, later), "left")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, ats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                gone = covered(len(words), ats, rule.window)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, ~gone) if removed[-1] else words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = both.select(keyed["_id"], "_text", "ats").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, rule: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts.

    Lines stay lines, lines and documents of which nothing is left go, and texts
    without a repeat stay as they are.
    """
    bound_arrow_batches(docs.sparkSession)
    inner, restored = shielded(docs, id_col, text_col)
    later = repeats(keyed_texts(inner).withColumn("_id", F.col("_id").cast("long")), rule)
    left = inner.withColumn("_sth", F.xxhash64(F.coalesce("text", F.lit(""))))
    match = left["doc_id"].cast("long").eqNullSafe(later["_id"]) & (left["_sth"] == later["_th"])
    both = left.join(later, match, "left").select("doc_id", "text", "_rest", "ats")

    def cut(text: str, ats: list[int]) -> str:
        lines = [line.split() for line in text.encode().split(b"\n")]
        gone = covered(sum(map(len, lines)), ats, rule.window)
        out, done = [], 0
        for words in lines:
            kept = list(compress(words, ~gone[done : done + len(words)]))
            done += len(words)
            if kept:
                out.append(b" ".join(kept).decode())
        return "\n".join(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ats = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = [cut(t, a) if a else t for t, a in zip(texts, ats, strict=True)]
            left = pa.array([t != "" or not a for t, a in zip(texts, ats, strict=True)], pa.bool_())
            columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "_rest"]).filter(left)

    return restored(both.mapInArrow(run, inner.schema))
