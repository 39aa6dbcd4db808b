"""Exact n-gram Jaccard join of whole texts.

Texts with equal shingle sets form a class. Two sets that are similar enough
share one of the first shingles of each in a common order, with frequent
shingles last. Sets that share such a shingle make pairs; where many share one,
they come to the same group, and groups are cut into tiles by bands of set size.
Hashed bitmaps bound the overlap of a pair, or of two sets of a tile, from above.
The sets that some bound leaves together are tiled with their texts, and pairs
that may pass are intersected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tabscope.llm.common import bound_arrow_batches, broadcast_if_small, keyed_texts, same_key, shielded
from tabscope.llm.components import Forest, components
from tabscope.llm.shingles import shingle_set
from tabscope.session import stage_table


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``n`` words; sets link from ``percent`` of their union on."""

    n: int = 5
    percent: int = 80

    def fits(self, small: np.ndarray | int, large: np.ndarray | int) -> np.ndarray | bool:
        return 100 * small >= self.percent * large

    def prefix(self, size: int) -> int:
        """So many first shingles of a set meet those of every set that links with it."""
        return size + (-self.percent * size // 100) + 1


#: Shingles put last in the order are sought in every ``SAMPLE``-th text and among the lowest
#: quarter of hashes, where prefixes lie; they count as frequent from ``OFTEN`` sampled texts on, and
#: at most ``FREQUENT`` are told to all tasks. All this affects only the time: any order gives all links.
SAMPLE, OFTEN, FREQUENT = 4, 3, 4_000_000
LOW = np.uint64(1 << 62)
TILE_DOCS = 128
#: Sets that share a shingle make pairs if there are at most so many and one; more are tied to one group.
PAIRED = 32
#: Rows of shingles that are looked through at once.
RUN_ROWS = 50_000
#: A task hands its trees on when it has met so many sets.
FOREST_NODES = 500_000
#: A set's bitmap has at least as many bits as the set has members, within these bounds.
LEAST_BITS, MOST_BITS = 128, 1 << 17
#: Keys of texts that are fetched by broadcast; more are fetched by shuffle.
FETCHED = 500_000


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_members(keyed: DataFrame, rule: Similarity) -> DataFrame:
    """_id, _th, c1, c2, n, mark: two hashes of each text's set, its size and bitmap; none for a text without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, rule.n) for t in batch.column(2).to_pylist()]
            marks = pa.array([signature(x).tobytes() if len(x) else None for x in own], pa.binary())
            sets = [x.tobytes() for x in own]
            digests = [[xxh3_64_intdigest(s, seed) if s else None for s in sets] for seed in (1, 2)]
            hashes = [pa.array([d and d - (1 << 63) for d in ds], pa.int64()) for ds in digests]
            sizes = pa.array([len(s) // 8 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *hashes, sizes, marks], ["_id", "_th", "c1", "c2", "n", "mark"])

    kind = keyed.schema["_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"_id {kind}, _th long, c1 long, c2 long, n long, mark binary")


def frequent_shingles(keyed: DataFrame, rule: Similarity) -> np.ndarray:
    """Sorted hashes of at most ``FREQUENT`` shingles that many texts hold."""
    sampled = keyed.filter(F.pmod("_th", F.lit(SAMPLE)) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s[s < LOW] for t in batch.column(2).to_pylist() for s in [shingle_set(t, rule.n)]]
            found, counts = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(counts, pa.int64())], ["s", "k"])

    counted = sampled.mapInArrow(run, "s long, k long").groupBy("s").agg(F.sum("k").alias("k"))
    most = stage_table(counted.filter(F.col("k") >= OFTEN), "jaccard-frequent")
    if most.count() > FREQUENT:
        most = most.orderBy(F.desc("k"), "s").limit(FREQUENT)
    return np.sort(most.select("s").toArrow()["s"].to_numpy().view(np.uint64))


class Runs:
    """Looks through rows (shingle, set, size), in this order, run by run of a shingle, for sets that may link."""

    def __init__(self, rule: Similarity):
        self.rule, self.last, self.long = rule, np.zeros((3, 0), dtype=np.int64), False

    def look(self, rows: np.ndarray, ended: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and ties of sets, each ``[2, n]``: all pairs of a short run that are near in size, and neighbours by size of a long one.

        Where one gap between neighbours is too wide, no pair spans it. The last run is kept until it has ended or is long.
        """
        rows = np.hstack([self.last, rows])
        # A class may have been posted by several tasks.
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        rows = rows[:, new]
        first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])[: rows.shape[1]])
        length = np.diff(np.append(first, rows.shape[1]))
        long = length > PAIRED + 1
        long[:1] |= self.long
        if len(first) and not ended:
            keep = 1 if long[-1] else length[-1]
            self.last, self.long = rows[:, rows.shape[1] - keep :], bool(long[-1])
            if not self.long:
                rows, length, long = rows[:, :-keep], length[:-1], long[:-1]
        s, c, n = rows
        inside = np.repeat(long, length)
        pairs, at = [np.zeros((2, 0), dtype=np.int64)], np.flatnonzero(~inside)
        for back in range(1, PAIRED + 1):
            at = at[at >= back]
            at = at[s[at] == s[at - back]]
            if not len(at):
                break
            near = at[self.rule.fits(n[at - back], n[at])]
            pairs.append(np.stack([c[near], c[near - back]]))
        near = np.flatnonzero(inside[1:] & (s[1:] == s[:-1]) & self.rule.fits(n[:-1], n[1:])) + 1
        return np.hstack(pairs), np.stack([c[near], c[near - 1]])


def shared_prefixes(keyed: DataFrame, rule: Similarity) -> DataFrame:
    """(a, b, tie) of set hashes: all sets that may link are a pair, or tied together."""
    spark = keyed.sparkSession
    told = spark.sparkContext.broadcast(frequent_shingles(keyed, rule))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = told.value, set()
        for batch in batches:
            shingles, classes, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, rule.n)
                if not len(own):
                    continue
                # As class_members numbers them; a class is posted once by a task.
                c1 = xxh3_64_intdigest(own.tobytes(), 1) - (1 << 63)
                if c1 in seen:
                    continue
                seen.add(c1)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    often = frequent[at] == own
                    own = np.concatenate((own[~often], own[often]))
                first = own[: rule.prefix(len(own))]
                shingles.append(first)
                classes.append(np.full(len(first), c1))
                sizes.append(np.full(len(first), len(own)))
            if shingles:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(shingles))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))],
                    ["s", "c", "n"],
                )

    def tie(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, runs, held, size = Forest(), Runs(rule), [], 0

        def found(ends: np.ndarray, tied: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ends), pa.array(np.full(ends.shape[1], tied))], ["a", "b", "tie"])

        def looked(ended: bool) -> pa.RecordBatch:
            nonlocal size
            pairs, ties = runs.look(np.hstack([np.zeros((3, 0), dtype=np.int64), *held]), ended)
            held.clear()
            size = 0
            for a, b in np.unique(ties, axis=1).T.tolist():
                forest.join(a, b)
            return found(np.unique(np.sort(pairs, axis=0), axis=1), False)

        def stars() -> pa.RecordBatch:
            return found(np.array(forest.stars(), dtype=np.int64), True)

        for batch in batches:
            held.append(np.array([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size >= RUN_ROWS:
                yield looked(False)
            if len(forest.parent) > FOREST_NODES:
                yield stars()
        yield looked(True)
        yield stars()

    posted = keyed.mapInArrow(post, "s long, c long, n long")
    return posted.repartition("s").sortWithinPartitions("s", "n", "c").mapInArrow(tie, "a long, b long, tie boolean")


def folded(marks: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps by row, brought to a narrower width."""
    while marks.shape[1] > width:
        half = marks.shape[1] // 2
        marks = marks[:, :half] | marks[:, half:]
    return marks


def likely_pairs(pairs: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """Those of the pairs (a, b) that the bitmaps of ``classes`` (c1, n, mark) don't rule out."""
    own = lambda end: classes.select(F.col("c1").alias(end), F.col("n").alias(f"n{end}"), F.col("mark").alias(f"m{end}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in ("a", "b", "na", "nb"))
            marks = [[np.frombuffer(m, dtype=np.uint64) for m in batch.column(k).to_pylist()] for k in ("ma", "mb")]
            widths = np.array([[len(m) for m in side] for side in marks]).reshape(2, -1)
            fine = np.zeros(len(a), dtype=bool)
            for w_a, w_b in np.unique(widths, axis=1).T.tolist():
                at = np.flatnonzero((widths[0] == w_a) & (widths[1] == w_b))
                x, y = (folded(np.array([side[k] for k in at.tolist()]), min(w_a, w_b)) for side in marks)
                only_a = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                only_b = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
                most = np.minimum(n_a[at] - only_a, n_b[at] - only_b)
                fine[at] = rule.fits(most, n_a[at] + n_b[at] - most)
            yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine])], ["a", "b"])

    return pairs.join(own("a"), "a").join(own("b"), "b").mapInArrow(run, "a long, b long")


def tiles(active: DataFrame, rule: Similarity) -> DataFrame:
    """``active`` (cluster, c1, c2, n, ...) once for each tile it belongs to, with ``tile`` and ``side``.

    A cluster of few classes is one tile. Of a larger one, each band of sizes is
    dealt to blocks, and a tile is a pair of blocks of one band or of two that touch:
    sets in bands further apart are too unlike in size to link.
    """
    width = -np.log(rule.percent / 100)
    step = active.withColumn("band", F.floor(F.log("n") / F.lit(float(width)) - 1e-9).cast("long"))
    counts = step.groupBy("cluster", "band").agg(F.count("*").alias("k"))
    # A cluster has as many bands as there are sizes by powers, so its map stays small.
    shape = counts.groupBy("cluster").agg(
        F.sum("k").alias("all"),
        F.map_from_entries(
            F.collect_list(F.struct("band", F.ceil(F.col("k") / TILE_DOCS).cast("int").alias("m")))
        ).alias("blocks"),
    )
    step = step.join(shape, "cluster")
    number = lambda band: F.coalesce(F.element_at("blocks", band), F.lit(0))
    band = F.col("band")
    step = step.withColumn("own", F.pmod(F.xxhash64("c1", "c2"), number(band)).cast("int"))
    name = lambda *x: F.concat_ws("/", *(y.cast("string") for y in x))
    entry = lambda tile, side: F.struct(tile.alias("tile"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("own")
    same = F.transform(
        upto(number(band)),
        lambda j: F.struct(
            name(band, F.least(own, j), band, F.greatest(own, j)).alias("tile"),
            F.when(own <= j, 0).otherwise(1).alias("side"),
        ),
    )
    above = F.transform(upto(number(band + 1)), lambda j: entry(name(band, own, band + 1, j), 0))
    below = F.transform(upto(number(band - 1)), lambda j: entry(name(band - 1, j, band, own), 1))
    small = F.array(entry(F.lit("all"), 0))
    places = F.when(F.col("all") <= TILE_DOCS, small).otherwise(F.concat(same, above, below))
    return step.withColumn("place", F.explode(places)).select(
        *active.columns, F.concat_ws("/", F.col("cluster").cast("string"), F.col("place.tile")).alias("tile"), "place.side"
    )


def signature(own: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words, by the members' hashes modulo its width."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (len(own) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(own % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


class Marks:
    """Bitmaps of a tile, by width; a wider one is folded to meet a narrower one."""

    def __init__(self, marks: list[np.ndarray]):
        self.marks = marks
        self.width = np.array([len(m) for m in marks])
        self.place = np.zeros(len(marks), dtype=np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.array([marks[k] for k in at])

    def most_shared(self, i: int, js: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each j no wider than i, a bound from above on what sets i and j share.

        Every bit that only one of them has stands for a member that the other lacks.
        """
        out = np.zeros(len(js), dtype=np.int64)
        mine = self.marks[i]
        for w in sorted(set(self.width[js].tolist()), reverse=True):
            while len(mine) > w:
                mine = mine.reshape(2, -1)[0] | mine.reshape(2, -1)[1]
            at = self.width[js] == w
            theirs = self.rows[w][self.place[js[at]]]
            only_i = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
            out[at] = np.minimum(sizes[i] - only_i, sizes[js[at]] - only_j)
        return out


def linked(
    sizes: list[int], marks: list[np.ndarray], sides: list[int], rule: Similarity, sets=None, every: bool = False
) -> list[tuple[int, int]]:
    """Pairs of positions that tie a tile's sets into components, by the bound or, given ``sets``, exactly.

    With two sides only pairs across are compared. A pair that others already
    join is passed over, unless ``every`` link is wanted; every other is bounded
    and, if it may pass, intersected.
    """
    order = np.argsort(np.array(sizes), kind="stable")
    size, side = np.array(sizes)[order], np.array(sides)[order]
    bound = Marks([marks[k] for k in order])
    two = side.min(initial=0) != side.max(initial=0)
    root = np.arange(len(order))
    out = []
    for i in range(1, len(order)):
        js = np.arange(np.searchsorted(100 * size[:i], rule.percent * size[i]), i)
        js = js[(every | (root[js] != root[i])) & ((side[js] != side[i]) | (not two))]
        if not len(js):
            continue
        most = bound.most_shared(i, js, size)
        js, most = js[(may := rule.fits(most, size[i] + size[js] - most))], most[may]
        for j in js[np.argsort(-most, kind="stable")].tolist():
            if root[j] == root[i] and not every:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if not rule.fits(both, int(size[i] + size[j]) - both):
                    continue
            out.append((int(order[i]), int(order[j])))
            root[root == root[j]] = root[i]
    return out


def tied(group: pa.Table, name: str, pairs: list[tuple[int, int]], kind: pa.DataType) -> pa.Table:
    names, forest = group[name].to_pylist(), Forest()
    for i, j in pairs:
        forest.join(names[i], names[j])
    return pa.table({end: pa.array(x, kind) for end, x in zip("ab", forest.stars(), strict=True)})


def has_repeats(rows: DataFrame) -> bool:
    """Whether some row of a text with words is there more than once."""
    return not rows.filter("n > 0").groupBy("_id", "_th").count().filter("count > 1").isEmpty()


def compared(docs: DataFrame, rule: Similarity, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (documents with their class of equal sets), the classes, and the texts of classes that may link, by tile."""
    bound_arrow_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)
    members = stage_table(class_members(keyed, rule), "jaccard-members")
    classes = stage_table(
        members.filter("n > 0")
        .groupBy("c1", "c2")
        .agg(F.first("n").alias("n"), F.first("mark").alias("mark"), F.min(F.struct("_id", "_th")).alias("rep"), F.min("_id").alias("least"))
        .select("c1", "c2", "n", "mark", "rep._id", "rep._th", "least"),
        "jaccard-sets",
    )
    # Rows of one document are one text; they are made one only where there are any, as that deals out all texts.
    single = not has_repeats(members)

    def fetched(placed: DataFrame, source: DataFrame, *columns: str) -> DataFrame:
        """``placed`` with columns of each class's own document."""
        once = source if single else source.dropDuplicates(["_id", "_th"])
        keys = broadcast_if_small(placed, FETCHED)
        return once.join(keys, same_key(once, placed)).select(
            *(placed[c] for c in ("tile", "side", "c1", "c2", "n")), *(once[c] for c in columns)
        )

    def placed(clusters: DataFrame) -> DataFrame:
        cluster = clusters.select(F.col("node").alias("c1"), F.col("root").alias("cluster"))
        active = stage_table(classes.join(cluster, "c1").drop("least", "mark"), "jaccard-active")
        return stage_table(tiles(active, rule), "jaccard-tiles")

    def bounded(group: pa.Table) -> pa.Table:
        marks = [np.frombuffer(m, dtype=np.uint64) for m in group["mark"].to_pylist()]
        pairs = linked(group["n"].to_pylist(), marks, group["side"].to_pylist(), rule)
        return tied(group, "c1", pairs, pa.int64())

    shared = stage_table(shared_prefixes(keyed, rule), "jaccard-shared")
    near = fetched(placed(components(shared.filter("tie").select("a", "b"))), members, "mark")
    pairs = stage_table(likely_pairs(shared.filter("NOT tie").select("a", "b").distinct(), classes, rule), "jaccard-pairs")
    likely = components(near.groupBy("tile").applyInArrow(bounded, "a long, b long").unionByName(pairs))
    texts = fetched(placed(likely), keyed, "_text").withColumn("node", F.concat(F.hex("c1"), F.lit("-"), F.hex("c2")))
    return members, classes, texts


def near_duplicates(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """_id, _th, n, component, first: each document's set size, component and the component's least id.

    A text without words, or null, has size 0, no component and its own id as
    ``first``. Rows of equal id and text count as one document; a null id is
    passed over in ``first`` unless the component has no other. No rows give none.
    """
    members, classes, texts = compared(docs, rule, id_col, text_col)

    def compare(group: pa.Table) -> pa.Table:
        sets = [shingle_set(t, rule.n) for t in group["_text"].to_pylist()]
        marks = [signature(x) for x in sets]
        pairs = linked([len(x) for x in sets], marks, group["side"].to_pylist(), rule, sets)
        return tied(group, "node", pairs, pa.string())

    links = texts.groupBy("tile").applyInArrow(compare, "a string, b string")
    joined = components(links)
    node = F.concat(F.hex("c1"), F.lit("-"), F.hex("c2"))
    named = stage_table(
        classes.select("c1", "c2", "least", node.alias("node"))
        .join(joined, "node", "left")
        .select("c1", "c2", "least", F.coalesce("root", "node").alias("component")),
        "jaccard-classes",
    )
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    by_class = named.join(least, "component").select("c1", "c2", "component", "first")
    return members.join(by_class, ["c1", "c2"], "left").select(
        "_id", "_th", "n", "component", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("_id")).alias("first")
    )


def class_links(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (a, b, shared), and the documents with their class: _id, _th, n, node.

    Documents of equal sets are one class, so copies are not spread out into
    pairs; a text without words has no class.
    """
    members, _, texts = compared(docs, rule, id_col, text_col)

    def compare(group: pa.Table) -> pa.Table:
        nodes, sets = group["node"].to_pylist(), [shingle_set(t, rule.n) for t in group["_text"].to_pylist()]
        pairs = linked([len(x) for x in sets], [signature(x) for x in sets], group["side"].to_pylist(), rule, sets, every=True)
        shared = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs]
        ends = [sorted((nodes[i], nodes[j])) for i, j in pairs]
        columns = [pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)]
        return pa.table([*columns, pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    # A block whose partner turns out empty compares its own classes once more.
    links = texts.groupBy("tile").applyInArrow(compare, "a string, b string, shared long").distinct()
    node = F.when(F.col("n") > 0, F.concat(F.hex("c1"), F.lit("-"), F.hex("c2")))
    return links, members.select("_id", "_th", "n", node.alias("node"))


def link_counts(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n, node (the class of equal sets), n_links: with how many other documents each one links, copies included.

    Rows of equal id and text are one document and share their count.
    """
    links, members = class_links(docs, rule, id_col, text_col)
    links, members = stage_table(links, "jaccard-links"), stage_table(members, "jaccard-documents")
    sizes = members.filter("node IS NOT NULL").distinct().groupBy("node").agg(F.count("*").alias("k"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(sizes, both["b"] == sizes["node"]).groupBy("a").agg(F.sum("k").alias("others"))
    counts = sizes.join(other, sizes["node"] == other["a"], "left").select(
        "node", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    found = members.join(counts, "node", "left")
    return found.select(F.col("_id").alias("doc_id"), "n", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_report(docs: DataFrame, rule: Similarity = Similarity(4, 85)) -> DataFrame:
    """doc_id, n_shingles and the least doc_id of the component."""
    return near_duplicates(docs, rule).select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the document of the least id stays.

    Texts without words all stay. A component without ids keeps one of its texts.
    """
    inner, restored = shielded(docs, id_col, text_col)
    rows = stage_table(near_duplicates(inner, rule), "jaccard-found")
    found = rows.distinct()
    # A document stays if it is its component's first; ties of a null or repeated id go to the least text hash.
    ranked = found.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_th")).alias("stay")
    )
    stay = ranked.select("stay._id", "stay._th").unionByName(found.filter("n = 0").select("_id", "_th"))
    left = inner.withColumn("_jth", F.xxhash64(F.coalesce("text", F.lit(""))))
    match = left["doc_id"].eqNullSafe(stay["_id"]) & (left["_jth"] == stay["_th"])
    kept = left.join(stay, match, "left_semi")
    if has_repeats(rows):
        # The same row more than once: one stays, but for texts without words.
        same = Window.partitionBy("doc_id", "_jth").orderBy(F.lit(1))
        blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\f\r", "")) == ""
        repeated = kept.filter(~blank).withColumn("_jn", F.row_number().over(same)).filter("_jn = 1").drop("_jn")
        kept = repeated.unionByName(kept.filter(blank))
    return restored(kept)
