"""A manifest of a table as a Merkle tree whose nodes are stored by their digests.

Leaves are rows. Each source is a tree of runs of three, and the sources' roots
are the leaves of one more tree. What is stored are records from a digest to its
children, those of five levels together under the digest at their top (a
segment). A request for leaves descends from the root: the base-3 digits of a
leaf's rank select one child per level, the others are collected, and the
collected path, reversed, is the leaf's proof. Requests that share a prefix of
digits descend together, so no record is asked for once per leaf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.session import shared_path

ARITY = 3
#: Levels and leaves of a segment.
LEVELS = 5
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
SEGMENT = "tree long, idx long, size long, digest string, height int, nodes array<struct<digest:string,children:array<string>>>"


def framed(value: Column) -> Column:
    """A value with its length, so that no two rows of values give one text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's fields, some of them ``changed``."""
    return F.sha2(F.concat(*(framed(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def tampered_digest() -> Column:
    """The leaf of a row that lost its line ends, where the id's checksum is even; null where nothing changes."""
    without = F.regexp_replace("text", "\n", "")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return F.when(hit, leaf_digest(text=without))


def digest(texts: Iterable[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def fold(level: list[str], height: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """Digest at the top of ``height`` levels of runs, and the records of all nodes below and at it."""
    nodes = []
    for _ in range(height):
        runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
        level = [digest(run) for run in runs]
        nodes += zip(level, runs, strict=True)
    return level[0], nodes


def walk(top: str, nodes: dict[str, list[str]], height: int, place: int) -> tuple[str, list[tuple[str, str]]] | None:
    """The node ``place`` places from the left, ``height`` levels down, and the siblings passed; None beyond the last."""
    steps = []
    for level in reversed(range(height)):
        digit = place // ARITY**level % ARITY
        children = nodes[top]
        if digit >= len(children):
            return None
        steps.append(("".join(children[:digit]), "".join(children[digit + 1 :])))
        top = children[digit]
    return top, steps


def levels_of(size: int) -> int:
    height = 0
    while ARITY**height < size:
        height += 1
    return height


def rounds_of(size: int) -> int:
    """Segments on the way from a root to its leaves."""
    return -(-levels_of(size) // LEVELS)


def rounds_column(size: Column) -> Column:
    return sum((F.when(size > F.lit(SPAN**k), 1).otherwise(0) for k in range(7)), F.lit(0))


@dataclass
class Manifest:
    """Stored records. ``trees``: tree, source, size, subroot; ``segments`` and ``tops``: one frame per round, leaves first."""

    path: str
    trees: DataFrame
    segments: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def put(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, group: list[str], order: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_pid`` and ``_at``, their places in the order; and per group and part the first place and the rank there.

    Rows are dealt by ranges of group and order, so a group may span any number
    of parts. Rows that are equal in all of these are told apart by where they
    were read, so even many copies of one row don't meet in one task.
    """
    dealt = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_copy")
    numbered = dealt.sortWithinPartitions(*group, *order, "_copy").withColumn("_at", F.monotonically_increasing_id())
    stored = put(numbered.drop("_copy").withColumn("_pid", F.shiftright("_at", 33)), path)
    parts = stored.groupBy("_pid", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    return stored, parts.withColumn("_before", F.coalesce(before, F.lit(0)))


def folded(nodes: DataFrame, most: int, path: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, digest) and stored segments of trees given by nodes (tree, idx, size, digest), the largest of ``most``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                height = min(LEVELS, levels_of(r["size"]))
                top, records = fold([x["digest"] for x in r["below"]], height)
                out.append((r["tree"], r["idx"], r["size"], top, height, [{"digest": d, "children": c} for d, c in records]))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

    names = ["tree", "idx", "size", "digest", "height", "nodes"]
    record = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])
    kinds = pa.schema(
        list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(record)], strict=True))
    )
    roots, segments = nodes.filter("size = 1").select("tree", "digest"), []
    while most > 1:
        runs = nodes.filter("size > 1").groupBy("tree", F.expr(f"idx div {SPAN}").alias("_idx"))
        below = runs.agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("below"))
        segment = put(below.withColumnRenamed("_idx", "idx").mapInArrow(run, SEGMENT), f"{path}-{len(segments)}")
        segments.append(segment)
        nodes = segment.select("tree", "idx", F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"), "digest")
        roots = roots.unionByName(nodes.filter("size = 1").select("tree", "digest"))
        most = -(-most // SPAN)
    return roots, segments


def build(docs: DataFrame, path: str | None = None) -> tuple[Manifest, DataFrame]:
    """The manifest of documents, stored under ``path``, and its leaves as requests for :func:`prove`.

    Rows of one source stand by id, nulls first, then by digest. Null fields and
    a null source are values of their own; repeated rows are leaves of their own;
    further columns are left alone. An empty table has no root.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "manifest")
    own = docs.select(*FIELDS)
    rows = put(own.select("source", "doc_id", leaf_digest().alias("leaf"), tampered_digest().alias("presented")), f"{path}/rows")
    stored, parts = placed(rows, ["source"], ["doc_id", "leaf"], f"{path}/ordered")
    sizes = parts.groupBy("source").agg(F.sum("_rows").alias("size"))
    ordered, firsts = placed(sizes, [], ["source"], f"{path}/sources")
    trees = ordered.join(firsts, "_pid").select("source", "size", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))
    trees = put(trees, f"{path}/trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()

    at = parts.join(trees, parts["source"].eqNullSafe(trees["source"])).select(
        parts["source"].alias("_source"), F.col("_pid").alias("_part"), "tree", "size", (F.col("_before") - F.col("_first")).alias("_shift")
    )
    ranked = stored.join(at, (stored["_pid"] == at["_part"]) & stored["source"].eqNullSafe(at["_source"])).select(
        "tree", "size", (F.col("_at") + F.col("_shift")).alias("rank"), "doc_id", "leaf", "presented"
    )
    requests = put(in_blocks(ranked), f"{path}/leaves")
    nodes = requests.select("tree", "size", F.explode("wanted").alias("x")).select(
        "tree", F.col("x.rank").alias("idx"), "size", F.col("x.leaf").alias("digest")
    )
    roots, segments = folded(nodes, most, f"{path}/segments")
    trees = put(trees.join(roots.withColumnRenamed("digest", "subroot"), "tree"), f"{path}/subroots")
    heads = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("size"), F.col("subroot").alias("digest"))
    top, tops = folded(heads, n_trees, f"{path}/tops")
    head = top.first() if n_trees else None
    return Manifest(path, trees, segments, tops, head and head["digest"]), requests


def load(spark: SparkSession, path: str) -> Manifest:
    """A stored manifest; the files say how many rounds there are."""
    trees = spark.read.parquet(f"{path}/subroots")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    segments = [spark.read.parquet(f"{path}/segments-{k}") for k in range(rounds_of(most) if most else 0)]
    tops = [spark.read.parquet(f"{path}/tops-{k}") for k in range(rounds_of(n_trees) if n_trees else 0)]
    top = tops[-1].first()["digest"] if tops else (trees.first()["subroot"] if n_trees else None)
    return Manifest(path, trees, segments, tops, top)


def in_blocks(requests: DataFrame) -> DataFrame:
    """Requests (tree, size, rank, doc_id, leaf, presented) gathered by the segment of leaves they end in."""
    block = F.expr(f"rank div {SPAN}").alias("block")
    wanted = F.collect_list(F.struct("rank", "doc_id", "leaf", "presented"))
    return requests.groupBy("tree", "size", block).agg(wanted.alias("wanted"))


def below(frontier: DataFrame, segment: DataFrame, asked: DataFrame) -> DataFrame:
    """One segment down: from nodes (tree, idx, digest, above) to those that ``asked`` (tree, idx) names in the next round."""
    wanted = asked.select("tree", "idx").distinct().groupBy("tree", F.expr(f"idx div {SPAN}").alias("_up"))
    wanted = wanted.agg(F.collect_list("idx").alias("wanted"))
    rows = frontier.join(wanted.withColumnRenamed("_up", "idx"), ["tree", "idx"]).join(
        segment.select("digest", "height", "nodes").dropDuplicates(["digest"]), "digest"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nodes = {x["digest"]: x["children"] for x in r["nodes"]}
                for idx in r["wanted"]:
                    if found := walk(r["digest"], nodes, r["height"], idx % SPAN):
                        passed = [{"left": a, "right": b} for a, b in found[1]]
                        out.append({"tree": r["tree"], "idx": idx, "digest": found[0], "above": r["above"] + passed})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    kinds = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("digest", pa.string()), ("above", pa.list_(step))])
    return rows.select("tree", "idx", "digest", "above", "height", "nodes", "wanted").mapInArrow(
        run, f"tree long, idx long, digest string, above {STEPS}"
    )


def descend(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Nodes (tree, idx, digest, above) at the top of the leaves' segments, for the blocks that are requested."""
    spark = requests.sparkSession
    start = f"tree long, idx long, digest string, above {STEPS}"
    frontier = spark.createDataFrame([(0, 0, manifest.root, [])] if manifest.root else [], start)
    asked = requests.select("tree", "size", "block").distinct()
    top_asked = asked.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"))
    for k in reversed(range(len(manifest.tops))):
        frontier = below(frontier, manifest.tops[k], top_asked.withColumn("idx", F.expr(f"idx div {SPAN**k}")))
    # A tree of few rounds joins in when the descent is down at its root.
    heads = frontier.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "digest", "above")
    sizes = manifest.trees.select("tree", rounds_column(F.col("size")).alias("_rounds"))
    heads = put(heads.join(sizes, "tree"), shared_path(spark, "manifest-heads"))
    frontier = None
    for k in reversed(range(1, max(1, len(manifest.segments)))):
        own = heads.filter(F.col("_rounds") == k + 1).drop("_rounds")
        frontier = own if frontier is None else frontier.unionByName(own)
        frontier = below(frontier, manifest.segments[k], asked.select("tree", F.expr(f"block div {SPAN ** (k - 1)}").alias("idx")))
    low = heads.filter(F.col("_rounds") <= 1).drop("_rounds")
    return low if frontier is None else frontier.unionByName(low)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """For each request of :func:`in_blocks`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is what the descent finds at the request's rank, null (like the
    proof) where the manifest has no such leaf. ``folded_root`` is folded from
    the presented digest, or from the leaf where none is presented.
    """
    frontier = descend(manifest, requests).withColumnRenamed("idx", "block")
    kind = requests.schema["wanted"].dataType.elementType["doc_id"].dataType
    rows = requests.select("tree", "block", "wanted").join(frontier, ["tree", "block"])
    if manifest.segments:
        lowest = manifest.segments[0].select("digest", "height", "nodes").dropDuplicates(["digest"])
        rows = rows.join(lowest, "digest", "left")
    else:
        rows = rows.withColumns({"height": F.lit(0), "nodes": F.array().cast(SEGMENT.split("nodes ")[1])})
    rows = rows.join(manifest.trees.select("tree", "subroot"), "tree")
    root = manifest.root

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nodes = {x["digest"]: x["children"] for x in r["nodes"] or ()}
                above = [(x["left"], x["right"]) for x in r["above"]]
                for w in r["wanted"]:
                    found = walk(r["digest"], nodes, r["height"] or 0, w["rank"] % SPAN)
                    if found is None:
                        out.append((w["doc_id"], None, r["subroot"], root, None, None, False))
                        continue
                    path = [*reversed(above + found[1])]
                    proof = digest(a + b for a, b in path)
                    top = w["presented"] or found[0]
                    for a, b in path:
                        top = digest((a, top, b))
                    out.append((w["doc_id"], found[0], r["subroot"], root, proof, top, top == root))
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in names]
            ids = batch.schema.field("wanted").type.value_type.field("doc_id").type
            types = [ids, *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    narrow = rows.select("digest", "above", "height", "nodes", "wanted", "subroot")
    return narrow.mapInArrow(run, schema)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents against their manifest, where even checksums of ids present a tampered leaf."""
    manifest, requests = build(docs)
    return prove(manifest, requests)
