"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only.

Records hash into ``SLOTS`` virtual slots; bytes are summed per slot; a map gives each slot its shard. Version 1 of
the map is ``slot mod shards``. Rebalancing makes a new version by editing: a slot stays at home while the home
shard is below the mean, and the rest go, largest first, to the emptiest shard. Only the map is ever rewritten; the
slot of a record never changes. All versions stay in one table, so that a reader finds the map that a file was written by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written

SLOTS, SHARDS = 4096, 16


def slot_of(doc_id, text, slots: int = SLOTS):
    """Virtual slot of a record, by a hash of id and text: rows that share an id with a third of all rows are spread like others."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def record_size(text):
    """UTF-8 bytes of a text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def first_map(slots_df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 for the ``slots_df (vslot, bytes, ...)``: every slot at ``vslot mod shards``."""
    return slots_df.withColumn("version", F.lit(1)).withColumn("shard", F.col("vslot") % shards)


def edited_map(current: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map ``(version, vslot, shard, bytes, ...)``: same rows, ``shard`` edited where needed.

    The map has at most one row a slot, a fixed number however large the data, so its windows and its one folded
    array are of fixed size. In each shard, slots in falling order of bytes stay as long as their sum is at most the
    mean; those that go beyond it move to the shard with the least bytes at that time, larger slots first. Ties go
    by slot and shard number.
    """
    mean = current.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    home = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    held = current.crossJoin(F.broadcast(mean)).withColumn("stays", (F.sum("bytes").over(home) <= F.col("mean")) & (F.col("shard") < shards)).drop("mean")
    one = held.groupBy().agg(
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("vslot"))))).alias("movers"),
        F.array_agg(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("stayers"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("stayers", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"]),
    )
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,to:int>>").alias("moves"))

    def put(acc, slot):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v - slot["less"]).otherwise(v)).alias("loads"),
            F.array_append(acc["moves"], F.struct(slot["vslot"].alias("vslot"), to.alias("to"))).alias("moves"),
        )

    moves = one.select(F.inline(F.aggregate("movers", start, put, lambda acc: acc["moves"])))
    return held.join(moves, "vslot", "left").select(
        *[F.coalesce("to", "shard").alias("shard") if c == "shard" else (F.col(c) + 1).alias(c) if c == "version" else F.col(c) for c in current.columns]
    )


def write_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the table of maps at ``path``; a version that is there already is an error, as maps are only ever added."""
    version = slot_map.select("version").first()
    if version is not None:
        slot_map.drop("version").coalesce(1).write.parquet(f"{path}/version={version['version']}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the table of maps at ``path``, the last one by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def rebalanced(spark: SparkSession, path: str, weights: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Edits the last version at ``path`` into the next, stores it and returns it; ``weights (vslot, bytes, n)`` replaces the sizes, if given.

    Slots that are new in ``weights`` start at home, ``vslot mod shards``; those that are gone leave the map.
    """
    current = read_map(spark, path)
    if weights is not None:
        version = current.agg(F.max("version").alias("version"))
        current = weights.join(current.select("vslot", "shard"), "vslot", "left").crossJoin(F.broadcast(version))
        current = current.withColumn("shard", F.coalesce("shard", F.col("vslot") % shards))
    write_map(edited_map(current, shards), path)
    return read_map(spark, path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, rebalances: int = 1, maps: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version`` for every row of ``docs``.

    The law is ``bytes``: shards hold nearly equal sizes. ``slot`` is the row's place in its shard, gapless from 0:
    the rows of the shard's earlier virtual slots come first, then those of its own by doc_id. Null texts have size 1 and
    checksum 0; null doc_ids are spread by text, as repeated doc_ids are; rows equal in doc_id and text take neighbouring
    places. grown_shard is null under this law. Columns of ``docs`` besides doc_id and text are not read. The versions of the
    map are kept in the table ``maps``, a new one in the shared folder by default.

    The rows shuffle once, by virtual slot, without their text. Slots are counted with map-side sums.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        slot_of(F.col("doc_id").cast("long"), F.col("text"), slots).alias("vslot"),
    )
    rows, _ = written(rows, "records")
    weights = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    spark, maps = docs.sparkSession, maps or new_path(docs.sparkSession, "slot-maps")
    if weights.limit(1).count():
        write_map(first_map(weights, shards), maps)
        for _ in range(rebalances):
            rebalanced(spark, maps, shards=shards)
        slot_map = read_map(spark, maps)
    else:
        slot_map = first_map(weights, shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.join(F.broadcast(placed.select("vslot", "shard", "base", "version")), "vslot")  # at most one row a slot
        .withColumn("slot", F.col("base") + F.row_number().over(within) - 1)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
        )
    )
