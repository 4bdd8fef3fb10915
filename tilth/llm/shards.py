"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots; bytes are added up per slot; a versioned
map says which shard owns a slot.  Balancing edits the map, never the hash, so a change of
the map moves whole slots and nothing else.  Only DataFrame functions are used.

Defined results: a null text has no bytes (size 1) and the crc of no bytes, 0; an empty
table gives no rows; rows equal in id and text share a virtual slot and take places of
their own; an input column named like an added one is replaced by it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tilth.session import fresh_path, staged

#: Virtual slots; a constant of the data set, so that maps of all versions fit together.
SLOTS = 4096
#: Parts of a slot in which rows are numbered, so that no task numbers a whole shard.
PARTS = 16
ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version")


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its key (of its text where the key is null)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))), F.lit(slots)).cast("int")


def record_size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes) for every slot, empty ones too, from columns slot and size."""
    seen = records.groupBy("slot").agg(F.sum("size").alias("bytes"))
    every = records.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("slot"))
    return every.join(seen, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _placed(totals: DataFrame, loads: DataFrame) -> DataFrame:
    """(slot, shard, bytes): slots in falling size, each to the shard that is lightest so far.

    ``loads`` is one row with the array ``loads`` of the shards' bytes before.  The table has
    at most one row per slot, a fixed number, so it is folded within a single row.
    """
    ordered = totals.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot"))).alias("slots")
    )
    before = F.struct(
        F.col("loads"), F.array().cast("array<struct<slot:int,shard:int,bytes:bigint>>").alias("owned"),
    )

    def place(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        lightest = F.array_position(loads, F.array_min(loads)).cast("int") - 1
        heavier = F.transform(loads, lambda x, i: F.when(i == lightest, x - slot["less"]).otherwise(x))
        owner = F.struct(slot["slot"].alias("slot"), lightest.alias("shard"), (-slot["less"]).alias("bytes"))
        return F.struct(heavier.alias("loads"), F.concat(state["owned"], F.array(owner)).alias("owned"))

    owned = ordered.crossJoin(F.broadcast(loads)).select(F.explode(F.aggregate("slots", before, place)["owned"]).alias("o"))
    return owned.select("o.slot", "o.shard", "o.bytes")


def balanced_map(totals: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, slot, shard, bytes): slots in falling size, each to the shard that is lightest so far."""
    empty = totals.sparkSession.range(0, 1, 1, 1).select(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"))
    return _placed(totals, empty).select(F.lit(version).alias("version"), "slot", "shard", "bytes")


def edited_map(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version for the bytes of ``totals`` on ``shards`` shards; few slots move.

    Where shards differ by more than a slot, those above the mean give up slots down to it;
    these, and the slots of shards there are no more, go to the lightest shards.
    """
    held = old.select("slot", "shard").join(totals, "slot")
    every = held.sparkSession.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
    sums = every.join(held.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left")
    spread = sums.select(F.coalesce("load", F.lit(0)).alias("load")).agg((F.max("load") - F.min("load")).alias("gap"))
    mean = totals.agg((F.sum("bytes") / shards).alias("mean"), F.max("bytes").alias("largest"))
    line = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    even = (F.col("gap") <= F.col("largest")) | (F.col("upto") <= F.col("mean"))
    marked = held.withColumn("upto", F.sum("bytes").over(line)).crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(mean)).select(
        "slot", "shard", "bytes", ((F.col("shard") < shards) & even).alias("stays"))
    stay = marked.where("stays")
    loads = every.join(stay.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    moved = _placed(marked.where("NOT stays").select("slot", "bytes"), loads)
    after = old.agg((F.max("version") + 1).alias("version"))
    return stay.select("slot", "shard", "bytes").unionByName(moved).crossJoin(F.broadcast(after)).select("version", "slot", "shard", "bytes")


def grown_map(old: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more: it takes slots off the others, and nothing else moves.

    Every old shard gives up slots of about a (shards + 1)-th of its bytes.
    """
    line = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("bytes").over(Window.partitionBy("shard")) / F.lit(shards + 1)
    return old.select(
        (F.col("version") + 1).alias("version"),
        "slot",
        F.when(F.sum("bytes").over(line) <= share, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
        "bytes",
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions are folders and are never changed."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the latest."""
    every = spark.read.parquet(path)
    latest = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == latest)


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version at ``path``, or None where no map is stored."""
    try:
        return read_map(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def next_map(totals: DataFrame, shards: int, path: str) -> DataFrame:
    """The map to use for the bytes of ``totals``: version 1 where none is stored at ``path``,
    else the latest one, edited and stored as the next version where any slot has to move."""
    spark = totals.sparkSession
    old = stored_map(spark, path)
    if old is None:
        store_map(balanced_map(totals, shards), path)
        return read_map(spark, path)
    if old.count() != totals.count():
        raise ValueError(f"the map at {path} has another number of slots")
    new = staged(edited_map(old, totals, shards), "edited-map")
    if new.join(old.select("slot", F.col("shard").alias("was")), "slot").where("shard <> was").isEmpty():
        return old
    store_map(new, path)
    return read_map(spark, path)


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text",
          map_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, virtual_slot, shard, slot and map_version.

    The shards' sizes in bytes come out near equal.  A map stored at ``map_path`` is edited,
    so that only slots of shards grown too heavy move, or those a new number of shards asks for.  ``slot`` is the record's place in its
    shard, without gaps from 0: slots of the map in turn, then rows by key.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    records = docs.select(F.struct(*kept).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text")).select(
        "__row", "__key",
        record_size("__text").alias("size"),
        F.crc32(F.coalesce("__text", F.lit(""))).alias("text_crc32"),
        slot_of("__key", "__text", slots).alias("slot"),
        F.pmod(F.xxhash64("__key", "__text", F.lit(1)), F.lit(PARTS)).cast("int").alias("__part"),
    )
    totals = staged(records.groupBy("slot", "__part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "slot-bytes")
    path = map_path or fresh_path(spark, "slot-map")
    owners = next_map(staged(slot_bytes(totals, slots), "slot-totals"), shards, path).select("slot", "shard", F.col("version").alias("map_version"))
    before = Window.partitionBy("shard").orderBy("slot", "__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        totals.join(F.broadcast(owners), "slot")
        .withColumn("__base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select("slot", "__part", "shard", "map_version", "__base")
    )
    inside = Window.partitionBy("slot", "__part").orderBy("__key", "text_crc32", "size")
    numbered = records.withColumn("__line", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(bases), ["slot", "__part"]).select(
        "__row.*", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard",
        (F.col("__base") + F.col("__line")).alias("slot"), "map_version",
    )
