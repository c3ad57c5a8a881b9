"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, thousands of them.  Bytes and rows are
aggregated per slot, and a small versioned table maps slots to shards.  Rebalancing edits that
table: a new version moves whole slots, the hash of a record never changes.

Law ``bytes``: the first version gives the slots, largest first, to the least loaded shard, so
shard sizes differ by less than one small slot unless a single record outweighs a shard.

Edge cases: a null text has no bytes (size 1); a null doc_id hashes like any value; rows that
share a doc_id share a slot; slots without rows stay in the map with 0 bytes; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, written

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: depends on the key and the fixed number of slots alone."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot of each record; the text itself is not carried on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col(id_col), slots).alias("vslot"))


def slot_stats(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, n_rows for every slot, those without rows included."""
    spark = records.sparkSession
    got = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(got, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: slots, largest first, each to the least loaded shard (lowest on ties).

    One row holds the slots (as many as the fixed number of slots), folded with the shard loads as state.
    """
    one = stats.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("bytes")).alias("neg"), "vslot", "bytes", "n_rows"))).alias("s"))

    def give(acc: Column, e: Column) -> Column:
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        return F.struct(
            F.transform(acc["load"], lambda v, i: F.when(i == to, v + e["bytes"]).otherwise(v)).alias("load"),
            F.concat(acc["to"], F.array(to)).alias("to"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
                    F.array().cast("array<int>").alias("to"))
    rows = one.select(F.explode(F.arrays_zip(
        "s", F.aggregate("s", zero, give, lambda acc: acc["to"]).alias("shard"))).alias("r"))
    return rows.select(F.lit(1).alias("version"), F.col("r.s.vslot").alias("vslot"),
                       F.col("r.shard").alias("shard"), F.col("r.s.bytes").alias("bytes"),
                       F.col("r.s.n_rows").alias("n_rows"))


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard: each shard hands over what it has beyond the new mean.

    Slots move only into the new shard; the edit touches no other row of the map.
    """
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards + 1)
    over = F.sum("bytes").over(Window.partitionBy("version", "shard")) - F.col("_mean")
    handed = F.sum("bytes").over(Window.partitionBy("version", "shard").orderBy("vslot")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (slot_map.withColumn("_mean", mean).withColumn("_over", over).withColumn("_handed", handed)
            .select((F.col("version") + 1).alias("version"), "vslot",
                    F.when((F.col("_handed") <= F.col("_over")) & (F.col("bytes") > 0), F.lit(shards))
                    .otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n_rows"))


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of each record, and its place in the shard: slots in order, records by id inside a slot.

    Only the map (one row per slot) is broadcast; records are shuffled once, by slot.
    """
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n_rows")
    m = slot_map.select("version", "vslot", "shard", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return (records.withColumn("_inside", inside).join(F.broadcast(m), "vslot")
            .withColumn("slot", (F.col("_before") + F.col("_inside") - 1).cast("long")))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, slot map): both read tables written in the shared folder."""
    ready(docs.sparkSession)
    records = written(sized(docs, slots), "shard-records")
    slot_map = written(first_map(slot_stats(records, slots), shards), "shard-map")
    return place(records, slot_map), slot_map


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard(documents(spark, sf_dir), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
