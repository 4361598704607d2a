"""Sharding through fixed virtual slots.

A record is hashed by id and text into one of ``SLOTS`` virtual slots, for good (rows that repeat
more than ``REPEATS`` times are dealt over all slots, one by one). One pass adds up
records and bytes of each slot; the slot-to-shard map is made from these sums (heaviest slot
first, always to the lightest shard) and stored as version 1 of a table. Rebalancing does
not rehash: it loads the latest map, edits it, moving as few slots as it can, and stores the
next version; a map that need not change gets none.
Slot sums and maps have ``SLOTS`` rows however large the data, so the driver handles them.

A record's place in its shard is the number of records in the shard's earlier slots plus its
number within its slot, so no shard is ever sorted as a whole.

Defined results: a null text has no bytes and the checksum of the empty text; records without an
id are spread by their text; repeated records get places of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, stored, table

SLOTS = 8192
REPEATS = 1000


def balanced_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Every slot to a shard, heaviest first to the shard that is lightest so far."""
    free = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        load, shard = heapq.heappop(free)
        placed[slot] = shard
        heapq.heappush(free, (load + loads.get(slot, 0), shard))
    return placed


def edited_map(current: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map after rebalancing onto *shards* shards, changed only where it has to be.

    Slots of shards that no longer exist move; then, while a slot of a heavy shard (heaviest
    first) narrows its gap to the lightest one, the largest such slot moves there.
    """
    placed = {slot: shard for slot, shard in current.items() if shard < shards}
    total = {shard: 0 for shard in range(shards)}
    inside: dict[int, list[tuple[int, int]]] = {shard: [] for shard in range(shards)}

    def put(slot: int, shard: int) -> None:
        placed[slot] = shard
        total[shard] += loads.get(slot, 0)
        inside[shard].append((loads.get(slot, 0), slot))

    for slot, shard in list(placed.items()):
        put(slot, shard)
    for slot in sorted(current.keys() - placed.keys(), key=lambda s: (-loads.get(s, 0), s)):
        put(slot, min(total, key=lambda s: (total[s], s)))
    while True:
        light = min(total, key=lambda s: (total[s], s))
        for heavy in sorted(total, key=lambda s: (-total[s], s)):  # one giant slot must not hold up the others
            fitting = [x for x in inside[heavy] if 0 < x[0] <= (total[heavy] - total[light]) // 2]
            if fitting:
                break
        else:
            return placed
        load, slot = max(fitting)
        inside[heavy].remove((load, slot))
        total[heavy] -= load
        put(slot, light)


def store_map(spark: SparkSession, path: str, version: int, placed: dict[int, int]) -> None:
    """Add a version of the map; an existing version is never overwritten."""
    rows = spark.createDataFrame(sorted(placed.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """A stored version of the map, the latest by default."""
    rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    wanted = rows.agg(F.max("version")).first()[0] if version is None else version
    return {r.virtual_slot: r.shard for r in rows.where(F.col("version") == wanted).collect()}


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the latest version, 0 where no map has been stored yet."""
    try:
        rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return rows.agg(F.max("version")).first()[0] or 0


def rebalanced(spark: SparkSession, path: str, loads: dict[int, int], shards: int) -> tuple[dict[int, int], int]:
    """The map for these loads and shards with its version: the first one, or the latest edited."""
    version = latest_version(spark, path)
    current = load_map(spark, path, version) if version else None
    placed = edited_map(current, loads, shards) if current else balanced_map(loads, shards)
    if placed != current:
        version += 1
        store_map(spark, path, version, placed)
    return placed, version


def slotted(records: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """Rows (id, size, text_crc32, virtual_slot); size is the text's UTF-8 bytes plus 8."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = records.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("key"),
    )
    repeats = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("key", F.lit(True).alias("often")), "repeats")
    spread = F.when(F.col("often"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("key"))
    return rows.join(repeats, "key", "left").select("id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(placed_rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and records of every slot that has any: SLOTS entries at most."""
    sums = placed_rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    return {r.virtual_slot: (r.bytes, r.records) for r in sums.collect()}


def sharded(
    records: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, next_shards: int | None = None,
) -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard).

    A map stored under *map_path* is edited for the records and shards at hand. With *next_shards*
    the map is edited once more, for that many shards, and stored as the following version;
    ``next_shard`` is where it puts a record.
    """
    spark = records.sparkSession
    placed_rows = stored(slotted(records, id_col, text_col), "slots")
    sums = slot_sums(placed_rows)
    loads = {slot: size for slot, (size, _) in sums.items()}
    path = map_path or fresh_path(spark, "slot-map")
    shard_of, version = rebalanced(spark, path, loads, shards)
    after = rebalanced(spark, path, loads, next_shards)[0] if next_shards else {}
    rows, filled = [], [0] * shards
    for slot in sorted(sums):
        rows.append((slot, shard_of[slot], filled[shard_of[slot]], after.get(slot)))
        filled[shard_of[slot]] += sums[slot][1]
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, before long, next_shard int")  # at most SLOTS rows
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    return (
        placed_rows.withColumn("number", number).join(F.broadcast(places), "virtual_slot")
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot", F.lit(version).alias("map_version"), "next_shard")
    )


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), 24, next_shards=25)


QUERIES = {"op4_virtual_slots": op4_virtual_slots}
ORACLES: dict[str, str] = {}
