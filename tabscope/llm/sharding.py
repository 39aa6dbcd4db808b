"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots. Bytes are summed per slot, and a map
gives each slot to a shard. Rebalancing edits the map: it moves whole slots from
heavy shards to light ones and stores the result as the map's next version.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.llm.common import literal_array
from tabscope.session import shared_path, stage_table

SLOTS = 4096
MAP = "version int, vslot int, shard int"
SHARDS = 16
TOLERANCE = 1e-4
#: Slots are counted through in so many parts, none of which a task holds more of than a key's copies.
PARTS = 16
COPIES = 1000


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows, one per document: id, size, text_crc32, vslot, part.

    A null text has size 1 and the checksum of the empty text. A null id is
    hashed as null together with the text, so such rows spread over the slots.
    A row that repeats more than ``COPIES`` times is hashed with its place in the
    table as well, so that its copies spread too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = stage_table(rows, "shard-rows")
    key = F.xxhash64("doc_id", "text_crc32")
    # At most one row for each COPIES rows.
    many = rows.groupBy(key.alias("_key")).count().filter(F.col("count") > COPIES).select("_key", F.col("_key").isNotNull().alias("_many"))
    spread = rows.withColumn("_key", key).join(F.broadcast(many), "_key", "left")
    key = F.when(F.col("_many"), F.xxhash64("_key", "_at")).otherwise(F.col("_key"))
    slot, part = F.pmod(key, F.lit(slots)).cast("int"), F.pmod(F.shiftright(F.xxhash64(key), 8), F.lit(PARTS)).cast("int")
    return stage_table(spread.select("doc_id", "size", "text_crc32", slot.alias("vslot"), part.alias("part"), "_at"), "slotted")


def part_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each part of a slot that has any: at most slots times ``PARTS`` rows."""
    return rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until no single move or swap brings the heaviest and the lightest shard nearer.

    ``shards`` may exceed the shards in use; new ones start empty. Works on the
    slots' totals alone, whose number is fixed.
    """
    owner = list(owner)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].append((weight[slot], slot))
    for own in held:
        own.sort()
    load = [sum(w for w, _ in own) for own in held]
    enough = tolerance * sum(load) / shards

    def move(slot_at: int, source: int, target: int) -> None:
        w, slot = held[source].pop(slot_at)
        held[target].insert(bisect_left(held[target], (w, slot)), (w, slot))
        owner[slot] = target
        load[source] -= w
        load[target] += w

    while True:
        heavy, light = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        if gap <= enough:
            return owner
        best, best_at, back_at = gap, -1, -1
        # What moves from heavy to light, less what moves back, should come near half the gap.
        for back, w_back in [(-1, 0), *((k, w) for k, (w, _) in enumerate(held[light]))]:
            wanted = w_back + gap / 2
            at = bisect_left(held[heavy], (wanted, -1))
            for k in (at - 1, at):
                if 0 <= k < len(held[heavy]):
                    left = abs(gap - 2 * (held[heavy][k][0] - w_back))
                    if left < best:
                        best, best_at, back_at = left, k, back
        if best_at < 0:
            return owner
        slot_back = held[light][back_at][1] if back_at >= 0 else -1
        move(best_at, heavy, light)
        if slot_back >= 0:
            move(next(k for k, (_, s) in enumerate(held[light]) if s == slot_back), light, heavy)


def grown(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The map for one more shard, which takes slots from the heaviest ones only into itself."""
    owner = list(owner)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].append((weight[slot], slot))
    load = [sum(w for w, _ in own) for own in held]
    for own in held:
        own.sort()
    share, filled = sum(load) / (shards + 1), 0
    while True:
        heavy = max(range(shards), key=load.__getitem__)
        fits = bisect_left(held[heavy], (share - filled + 1, -1)) - 1
        if fits < 0 or held[heavy][fits][0] == 0:
            return owner
        w, slot = held[heavy].pop(fits)
        owner[slot] = shards
        load[heavy] -= w
        filled += w


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """Versions of the map as rows (version, vslot, shard)."""
    parts = [
        spark.range(len(owner)).select(
            F.lit(version).alias("version"),
            F.col("id").cast("int").alias("vslot"),
            F.element_at(literal_array(owner, "int"), (F.col("id") + 1).cast("int")).alias("shard"),
        )
        for version, owner in versions.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def stored_versions(spark: SparkSession, path: str) -> int:
    """The latest version of a stored map; 0 where there is none."""
    try:
        return spark.read.schema(MAP).parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A version of a stored map, the latest if none is named: the shard of each slot."""
    version = stored_versions(spark, path) if version is None else version
    rows = spark.read.schema(MAP).parquet(path).filter(F.col("version") == version).orderBy("vslot").collect()
    if not rows or [r.vslot for r in rows] != list(range(len(rows))):
        raise ValueError(f"{path} holds no whole version {version}")
    return [r.shard for r in rows]


def append_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Store a further version; one that is there already is never replaced."""
    if version <= stored_versions(spark, path):
        raise ValueError(f"{path} has a version {version} already")
    map_table(spark, {version: owner}).coalesce(1).write.mode("append").parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their shard and gapless place in it, and the stored map of all versions.

    Without a stored map at ``path`` version 1 deals slots in turn. The latest
    version, edited so that the shards' bytes are near equal, becomes the next one,
    which is in force. ``shards`` may exceed those of the stored map, not fall
    below them. An empty table gives no document rows and a map of empty slots.
    Places are counted inside the parts of slots, each of which starts where the
    parts and slots before it in its shard end, so no window holds a whole shard
    or slot.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "slot-map")
    version = stored_versions(spark, path)
    if not version:
        version = 1
        append_map(spark, path, version, first_map(slots, shards))
    before = stored_map(spark, path, version)
    if len(before) != slots or max(before) >= shards:
        raise ValueError(f"the map has {len(before)} slots on {max(before) + 1} shards, not {slots} on at most {shards}")
    rows = slotted(docs, slots)
    totals = {(r["vslot"], r["part"]): (r["bytes"], r["n"]) for r in part_bytes(rows).collect()}
    weight = [sum(totals.get((s, p), (0, 0))[0] for p in range(PARTS)) for s in range(slots)]
    owner = rebalanced(before, weight, shards)
    append_map(spark, path, version + 1, owner)
    filled = [0] * shards
    starts = []
    for s in range(slots):
        for p in range(PARTS):
            starts.append(filled[owner[s]])
            filled[owner[s]] += totals.get((s, p), (0, 0))[1]
    at = (F.col("vslot") + 1).cast("int")
    inside = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "_at"))
    start = F.element_at(literal_array(starts, "long"), (F.col("vslot") * PARTS + F.col("part") + 1).cast("int"))
    out = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(literal_array(owner, "int"), at).alias("shard"),
        (start + inside - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot"),
    )
    return out, spark.read.schema(MAP).parquet(path)
