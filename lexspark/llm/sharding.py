"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's virtual slot is a hash of its key and never changes.  What changes is the map
from slots to shards: bytes and rows are aggregated per slot, a greedy pass (largest slot
first, onto the lightest shard) makes version 1, and later versions are *edits* of the one
before that move as few slots as they can.  Every version is stored.

At scale: only narrow rows (key, size, checksum, slot) are shuffled, by slot; the driver
holds one row per slot, a number fixed by ``n_slots`` whatever the input's size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]`` for every slot; ``version`` grows by one with each edit."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes.get(slot, 0)
        return out


def plan(sizes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Largest slot first onto the lightest shard; ties by the lower number."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), held + 1, shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def grow(old: SlotMap, sizes: dict[int, int]) -> SlotMap:
    """One more shard: it takes slots from the others, and no slot moves between those."""
    new, shard_of = old.n_shards, list(old.shard_of)
    loads = [*old.loads(sizes), 0]
    target = sum(loads) / (new + 1)
    for slot in sorted(range(len(shard_of)), key=lambda s: (-sizes.get(s, 0), s)):
        size, shard = sizes.get(slot, 0), shard_of[slot]
        if size and loads[new] + size <= target + size / 2 and loads[shard] - size >= target - size / 2:
            shard_of[slot] = new
            loads[shard] -= size
            loads[new] += size
    return SlotMap(old.version + 1, new + 1, tuple(shard_of))


def rebalance(old: SlotMap, sizes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
    """Move slots from the heaviest to the lightest shard until all are within tolerance.

    Each move is the slot that comes closest to half of the gap; it ends when no move helps.
    """
    shard_of, loads = list(old.shard_of), old.loads(sizes)
    mean = sum(loads) / max(1, old.n_shards)
    while True:
        hi, lo = max(range(len(loads)), key=lambda s: (loads[s], -s)), min(range(len(loads)), key=lambda s: (loads[s], s))
        gap = loads[hi] - loads[lo]
        movable = [s for s in range(len(shard_of)) if shard_of[s] == hi and 0 < sizes.get(s, 0) < gap]
        if loads[hi] <= mean * (1 + tolerance) or not movable:
            break
        slot = min(movable, key=lambda s: (abs(sizes[s] - gap / 2), s))
        shard_of[slot] = lo
        loads[hi] -= sizes[slot]
        loads[lo] += sizes[slot]
    return SlotMap(old.version + 1, old.n_shards, tuple(shard_of))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version; a version that is there already is an error."""
    rows = [(s, shard, slot_map.n_shards) for s, shard in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard, n_shards, version) of one version, by default the newest."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def assign(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Shard, position in the shard and virtual slot of every row.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard,
    next_version``.  ``size`` is the text's UTF-8 bytes (null: none) plus one; ``slot`` is
    the row's place in its shard, gapless from 0; the law is ``bytes``.  The map is then edited for one more
    shard (version 2 gives it slots of the others, version 3 evens out what that left), every version is stored, and the last is read
    back as ``next_shard``.

    Nulls: a null text has size 1 and checksum 0; rows without an id are spread by a hash of
    their text.  Ties and repeated rows: rows with one id share a slot and are placed in the
    order of checksum and size; each keeps its own place.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    key, text = common.column(docs, id_col), common.column(docs, text_col)
    narrow = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.when(key.isNull(), text)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )
    per_slot = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    slot_map = plan({r["virtual_slot"]: r["bytes"] for r in per_slot}, n_shards, n_slots)  # version 1
    path = map_path or common.new_path(spark, "slot-map")
    sizes = {r["virtual_slot"]: r["bytes"] for r in per_slot}
    grown = grow(slot_map, sizes)
    for version in (slot_map, grown, rebalance(grown, sizes)):
        save_map(spark, version, path)
    before, seen = {}, [0] * n_shards
    for r in sorted(per_slot, key=lambda r: r["virtual_slot"]):
        before[r["virtual_slot"]] = seen[slot_map.shard_of[r["virtual_slot"]]]
        seen[slot_map.shard_of[r["virtual_slot"]]] += r["n"]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "virtual_slot int, before long")
    newest = load_map(spark, path).select("virtual_slot", F.col("shard").alias("next_shard"), F.col("version").cast("int").alias("next_version"))
    mapped = load_map(spark, path, slot_map.version).join(F.broadcast(offsets), "virtual_slot").join(F.broadcast(newest), "virtual_slot")  # n_slots rows
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        narrow.withColumn("place", place)
        .join(F.broadcast(mapped), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").cast("int").alias("map_version"), "next_shard", "next_version",
        )
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.documents(spark, sf_dir))
