"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of slots. Slots, not records, are placed on shards: a versioned
slot-to-shard map holds one row per slot, and growing or rebalancing edits that map, so only the rows of moved slots
move. The map is bounded by the number of slots whatever the data; nothing else is ever gathered.

Defined results: a null text counts as empty, a null key hashes like a value of its own, an empty table gives a map of
empty slots and no rows, equal rows share a slot and take consecutive places. Extra columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.session import stored

SLOTS = 4096
RECORD_OVERHEAD = 16


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows: key, size in bytes with the record's overhead, checksum of the text, and the virtual slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(slots)))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).withColumnRenamed("id", "virtual_slot")
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _placed(items: Column, loads: Column) -> Column:
    """Give the slots of ``items``, heaviest first, one by one to the lightest shard: an array of (slot, shard)."""

    def step(state, item):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == lightest, x + item["bytes"]).otherwise(x))
        place = F.struct(item["virtual_slot"].alias("virtual_slot"), lightest.cast("int").alias("shard"))
        return F.struct(grown.alias("loads"), F.concat(state["placed"], F.array(place)).alias("placed"))

    nothing = F.array().cast("array<struct<virtual_slot:bigint,shard:int>>")
    return F.aggregate(items, F.struct(loads.alias("loads"), nothing.alias("placed")), step, lambda state: state["placed"])


def _heaviest_first() -> Column:
    """The slots as one array; at most the fixed number of slots."""
    item = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    return F.sort_array(F.collect_list(item))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: slots by falling bytes, each to the lightest shard."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = loads.agg(_heaviest_first().alias("items")).select(F.explode(_placed(F.col("items"), zero)).alias("p"))
    return placed.select(F.lit(1).alias("version"), "p.virtual_slot", "p.shard")


def rebalanced(shard_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version: every shard keeps its largest slots up to the mean load, the others go to the lightest shards.

    ``shards`` may be larger than before. Slots that stay are not touched, so their rows do not move.
    """
    latest = shard_map.agg(F.max("version").alias("last"))
    now = shard_map.join(latest, F.col("version") == F.col("last")).join(loads, "virtual_slot")
    mean = loads.agg((F.sum("bytes") / shards).alias("mean"))
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    judged = now.withColumn("filled", filled).join(mean).withColumn("stays", F.col("filled") <= F.col("mean"))
    by_shard = judged.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    held = by_shard.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("held"))
    freed = judged.where("NOT stays").agg(_heaviest_first().alias("items"))
    loads_now = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long")))
    moved = freed.join(held).select(F.explode(_placed(F.col("items"), loads_now)).alias("p")).select("p.virtual_slot", "p.shard")
    return judged.where("stays").select("virtual_slot", "shard").unionByName(moved).join(latest).select((F.col("last") + 1).alias("version"), "virtual_slot", "shard")


def placed_rows(rows: DataFrame, loads: DataFrame, shard_map: DataFrame, order: list[str]) -> DataFrame:
    """Add each row's shard and its place there, counted from 0 without gaps.

    A slot's places begin where the slots before it in its shard end, so ranks are only taken inside a slot.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    begins = stored(shard_map.join(loads, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("begins")))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return rows.withColumn("place", rank).join(begins, "virtual_slot").withColumn("slot", F.col("begins") + F.col("place") - 1).drop("begins", "place")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Documents on shards of near equal bytes: key, size, checksum, virtual slot, map version, shard and place."""
    rows = stored(records(docs, slots=slots))
    loads = stored(slot_loads(rows, slots))
    return placed_rows(rows, loads, stored(first_map(loads, shards)), ["doc_id", "text_crc32", "size"])


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 39 by the law ``bytes``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    law = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    return out.withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "version")
