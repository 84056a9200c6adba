"""Sharding by fixed virtual slots.

A record's slot is a hash of its key modulo a fixed number of slots (thousands) and never
changes.  Bytes are added up per slot, and a slot map says which shard holds a slot.  Maps
are versioned tables: rebalancing or growing reads one version, moves some slots and
writes the next; records move only with their slots.

Only DataFrame expressions: the map has as many rows as there are slots, whatever the
data, so it is the one thing folded in a single expression and the one thing broadcast.
Neither texts nor other columns are shuffled; numbering inside the shards moves three
numbers per record, partitioned by slot.

Null texts have no bytes; a null key is hashed with the other key columns, so rows without
a doc_id spread by their texts.  Repeated rows share a slot.  Empty tables give a map of
empty slots and no rows.  Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.settings import fresh_path

SLOTS = 6_144


def size_of(text: str = "text", overhead: int = 8) -> Column:
    """Bytes of a record: its UTF-8 text plus a fixed part."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(overhead)).cast("long")


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).cast("int")


def slot_sizes(docs: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, records) of every slot, empty ones included."""
    seen = docs.select(slot_of(keys, slots).alias("vslot"), size_of().alias("_bytes"))
    sums = seen.groupBy("vslot").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("records"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records")
    )


class SlotMaps:
    """Versions of a slot-to-shard map under one folder, each a table (vslot, shard, bytes, records)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, slots: DataFrame, version: int) -> DataFrame:
        slots.select("vslot", "shard", "bytes", "records").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        return [r[0] for r in self.spark.read.parquet(self.path).select("version").distinct().orderBy("version").collect()]


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Slots in turn: equal numbers of slots, whatever they hold."""
    return sizes.withColumn("shard", F.pmod("vslot", F.lit(shards)))


def _deal(loose: Column, loads: Column) -> Column:
    """Each loose slot, largest first, to the shard with the least bytes so far."""
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("put"))

    def give(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == to - 1, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["put"], F.array(F.struct(slot["vslot"].alias("vslot"), (to - 1).alias("shard")))).alias("put"),
        )

    return F.aggregate(loose, start, give)["put"]


def rebalance(slots: DataFrame, shards: int) -> DataFrame:
    """The map edited so that every one of ``shards`` shards holds nearly equal bytes.

    Each shard keeps its largest slots up to the mean; what lies beyond is loose and goes,
    largest first, to the emptiest shards.  With more shards than before the new ones
    start empty, so slots move into them and, to even out, between others.
    """
    inside = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    marked = slots.withColumn("_stays", F.sum("bytes").over(inside) <= mean)
    loads = marked.where("_stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("_m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long"))).alias("_loads")
    )
    loose = marked.where("not _stays").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("_order"), "vslot", "bytes"))).alias("_loose")
    )
    dealt = loose.join(F.broadcast(loads)).select(F.explode(_deal(F.col("_loose"), F.col("_loads"))).alias("_p"))
    moved = dealt.select("_p.vslot", F.col("_p.shard").alias("_to"))
    return marked.join(moved, "vslot", "left").select("vslot", F.coalesce("_to", "shard").cast("int").alias("shard"), "bytes", "records")


def grow(slots: DataFrame, shards: int) -> DataFrame:
    """One shard more: every old shard hands its share of slots to the new one, nothing else moves."""
    turn = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    many = F.count("*").over(Window.partitionBy("shard"))
    goes = turn <= F.round(many / F.lit(shards + 1)).cast("int")
    return slots.withColumn("shard", F.when(goes, F.lit(shards)).otherwise(F.col("shard")).cast("int"))


def plan(docs: DataFrame, shards: int, keys: list[str], slots: int = SLOTS, path: str | None = None) -> SlotMaps:
    """Maps of a table: version 1 deals slots in turn, version 2 is edited by their bytes."""
    maps = SlotMaps(docs.sparkSession, path or fresh_path(docs.sparkSession, "slot-maps"))
    first = maps.write(first_map(slot_sizes(docs, keys, slots), shards), 1)
    maps.write(rebalance(first, shards), 2)
    return maps


def place(docs: DataFrame, slots: DataFrame, keys: list[str], n_slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``vslot`` and ``shard`` by one version of the map (one row per slot, broadcast)."""
    out = docs.withColumn("vslot", slot_of(keys, n_slots)).drop("shard")
    return out.join(F.broadcast(slots.select("vslot", "shard")), "vslot")


def numbered(placed: DataFrame, slots: DataFrame, order: list[str]) -> DataFrame:
    """``placed`` with ``slot``: positions 0, 1, 2, … inside each shard, slot after slot.

    The records before a slot are known from the map, so only the few inside a slot are sorted.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select("vslot", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("vslot").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return placed.join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("_before") + turn - 1).cast("long")).drop("_before")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, each record in the shard of its slot."""
    placed.write.partitionBy("shard").parquet(path)
