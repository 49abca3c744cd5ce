"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; bytes are summed per slot; a versioned map gives each slot its
shard. Rebalancing edits the map, never the hash, so that only the slots whose entry changes move.

The law held is `bytes`: shards are nearly equal in bytes. The map is bounded by the number of slots, a parameter,
whatever the size of the corpus; it alone is broadcast.

A record's slot is the hash of its id and text, so rows that repeat an id are spread by their texts. Equal records are
interchangeable; those that make up a slot's share of all records or more (there are no more of these than slots) are dealt
over all slots by a running number, so no slot, and no task that numbers one, holds a hot record. The measured records are
stored once, so every later step sees the same slots.

Defined results: a null text has no bytes (size 8, CRC-32 of nothing, 0). A null doc_id takes the slot of its text alone.
Rows of one slot are in the order of id, CRC-32 and size. An empty table gives no rows.
Columns of the input that carry the names used here are ignored by `assign`, which selects what it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

SLOTS = 8192
#: Bytes that a record has besides its text.
OVERHEAD = 8


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record, stored in the shared folder."""
    text, key = F.col("text"), [F.xxhash64(F.lit(i), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias(f"__h{i}") for i in (1, 2)]
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        *key,
        F.monotonically_increasing_id().alias("__number"),
    )
    rows = stored(rows, "records")
    again = rows.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = again.where(F.col("n") * slots >= rows.count()).select("__h1", "__h2", F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), ["__h1", "__h2"], "left")  # no more rows than slots
    own = F.when(F.col("__hot"), F.xxhash64("__h1", "__number")).otherwise(F.col("__h1"))
    return stored(marked.select("doc_id", "size", "text_crc32", F.pmod(own, F.lit(slots)).cast("int").alias("vslot")), "measured-records")


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any; no more rows than slots."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _fill(slots: Column, loads: Column) -> Column:
    """Largest slot first, each to the shard with the least bytes (ties to the smaller number). Gives [(vslot, shard)].

    A fold over an array of at most as many entries as there are virtual slots.
    """
    state = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"))

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda x, i: F.when(i == at, x + s["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(acc["placed"], F.array(F.struct(s["vslot"].alias("vslot"), at.alias("shard")))).alias("placed"))

    return F.aggregate(slots, state, step, lambda acc: acc["placed"])


def build_map(totals: DataFrame, shards: int, previous: DataFrame | None = None, slack: float = 0.02) -> DataFrame:
    """The slot-to-shard map: vslot, shard, bytes, rows.

    Without a previous map every slot is placed anew. With one, a slot keeps its shard as long as the slots kept there,
    largest first, stay within (1 + slack) times a shard's fair share; the others, and slots of shards that no longer
    exist or that are new, are placed where the least bytes are. Adding a shard so moves little more than its share.
    """
    fair = totals.agg(F.sum("bytes").alias("all_bytes"))
    if previous is None:
        kept = totals.withColumn("shard", F.lit(None).cast("int"))
    else:
        known = totals.join(previous.select("vslot", F.col("shard").alias("was")), "vslot", "left")
        known = known.withColumn("was", F.when(F.col("was") < shards, F.col("was")))
        run = F.sum("bytes").over(Window.partitionBy("was").orderBy(F.desc("bytes"), "vslot"))
        known = known.withColumn("run", run).crossJoin(F.broadcast(fair))  # one row
        kept = known.withColumn("shard", F.when(F.col("run") <= F.col("all_bytes") / shards * (1 + slack), F.col("was")))
    loads = [F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("bytes"))), F.lit(0)).cast("long") for i in range(shards)]
    free = F.collect_list(F.when(F.col("shard").isNull(), F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes")))
    stays = F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("vslot", "shard")))
    one = kept.agg(free.alias("free"), F.array(*loads).alias("loads"), stays.alias("stays"))
    placed = one.select(F.explode(F.concat("stays", _fill(F.sort_array("free"), F.col("loads")))).alias("p")).select("p.vslot", "p.shard")
    return placed.join(totals, "vslot")


def store_map(slot_map: DataFrame, root: str, version: int) -> str:
    """Writes one version of the map; earlier versions stay."""
    path = f"{root}/version={version}"
    slot_map.coalesce(1).write.parquet(path)
    return path


def load_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def assign(records: DataFrame, slot_map: DataFrame, next_map: DataFrame | None = None) -> DataFrame:
    """shard of every record, and slot, its gapless place in the shard; with a later version of the map, next_shard in it.

    Records are numbered within their virtual slot, and each virtual slot starts where the one before it in the shard
    ends: no task holds a whole shard, only its share of the virtual slots.
    """
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slot_map.select("vslot", "shard", before.alias("first"))
    later = [] if next_map is None else ["next_shard"]
    if next_map is not None:
        starts = starts.join(next_map.select("vslot", F.col("shard").alias("next_shard")), "vslot")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.withColumn("place", place)
        .join(F.broadcast(starts), "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.col("vslot").alias("virtual_slot"), *later)
    )


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, root: str | None = None, next_shards: int | None = None) -> DataFrame:
    """Version 1 of the map is built, stored under root (a new folder in the shared one) and applied to all records.

    next_shards: version 2, which is version 1 edited for so many shards, is stored too and gives next_shard.
    """
    spark = docs.sparkSession
    records = measured(docs, slots)
    root = root or scratch(spark, "slot-map")
    totals = slot_totals(records)
    store_map(build_map(totals, shards), root, 1)
    first, then = load_map(spark, root, 1), None
    if next_shards is not None:
        store_map(build_map(totals, next_shards, first), root, 2)
        then = load_map(spark, root, 2)
    return assign(records, first, then)
