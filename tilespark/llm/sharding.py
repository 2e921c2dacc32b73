"""Sharding by fixed virtual slots, in DataFrame operations only.

Each record hashes into one of ``n_slots`` fixed slots, by its text, so equal texts stay
together. Bytes are summed by slot, and a versioned map sends each slot to a shard. The
first version deals slots out evenly, before any bytes are known; each later one is the
stored one, read back and edited: slots move from heavy shards to light ones, records
never hash anew. A group of equal texts that is larger than a shard's share stays whole,
and so makes its shard larger.

Edge cases: a null or empty text has size 1, and null and empty texts are one group;
the id doesn't matter for the slot, so rows without id are like others; repeated rows
share a slot and get positions of their own; an empty table gives an empty result (and
a map of empty slots); other columns are ignored by ``positions`` and kept by
``assign``, a column ``shard`` as ``shard_before``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm import storage

N_SLOTS = 4096
#: Parts of a slot whose rows are numbered apart, so that no task holds a slot.
PARTS = 64
#: A map is edited while a shard is farther than that from the mean of those that can still be evened.
TOLERANCE = 0.0005


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shards[slot]`` is the slot's shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """slot int, shard int, map_version int: as many rows as slots, whatever the data."""
        text = F.lit(",".join(map(str, self.shards)))
        return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("vslot", "shard_text")).select("vslot", F.col("shard_text").cast("int").alias("shard"), F.lit(self.version).alias("map_version"))

    def save(self, spark: SparkSession, folder: str) -> str:
        path = f"{folder}/version={self.version}"
        self.frame(spark).select("vslot", "shard", F.lit(self.n_shards).alias("n_shards")).coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SlotMap | None:
        """The latest version that a folder holds; None if there is none."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = spark.read.schema("vslot int, shard int, n_shards int, version int").parquet(folder)
        last = rows.agg(F.max("version")).first()[0]
        if last is None:
            return None
        kept = rows.where(F.col("version") == last).orderBy("vslot").collect()
        return SlotMap(last, kept[0]["n_shards"], tuple(r["shard"] for r in kept))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(n_slots)).cast("int")


def bytes_by_slot(docs: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """The one thing the driver gets: ``n_slots`` numbers, summed where the rows are first."""
    found = docs.groupBy(slot_of(F.col("text"), n_slots).alias("vslot")).agg(F.sum(size_of(F.col("text"))).alias("n")).collect()
    sums = [0] * n_slots
    for slot, n in found:
        sums[slot] = n
    return sums


def even_map(n_slots: int, n_shards: int) -> SlotMap:
    return SlotMap(1, n_shards, tuple(s % n_shards for s in range(n_slots)))


def rebalanced(old: SlotMap, sums: list[int], n_shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
    """The next version: moves slots from the heaviest shard to the lightest while that helps.

    Only slots that move change. Fewer shards: the slots of those that go are dealt out first. A shard that
    no move can help, as one slot makes up most of it, is left alone and the others are evened.
    """
    n = n_shards or old.n_shards
    shards = list(old.shards)
    load = [0] * n
    own: list[set[int]] = [set() for _ in range(n)]
    homeless = []
    for slot, k in enumerate(shards):
        if k < n:
            load[k] += sums[slot]
            own[k].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sums[s], s)):
        k = min(range(n), key=lambda x: (load[x], x))
        shards[slot] = k
        own[k].add(slot)
        load[k] += sums[slot]
    able = set(range(n))
    while len(able) > 1:
        mean = sum(load[k] for k in able) / len(able)
        high, low = max(able, key=lambda x: (load[x], -x)), min(able, key=lambda x: (load[x], x))
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        gap = load[high] - load[low]
        fits = [s for s in own[high] if 0 < sums[s] < gap]
        if not fits:
            able.remove(high)
            continue
        slot = min(fits, key=lambda s: (abs(gap / 2 - sums[s]), s))
        own[high].remove(slot)
        own[low].add(slot)
        shards[slot] = low
        load[high] -= sums[slot]
        load[low] += sums[slot]
    return SlotMap(old.version + 1, n, tuple(shards))


def edited(spark: SparkSession, folder: str, sums: list[int], n_shards: int) -> SlotMap:
    """The map for these bytes: the stored one, or an even one that is stored first, edited and stored as the next version if anything moves."""
    if SlotMap.load(spark, folder) is None:
        even_map(len(sums), n_shards).save(spark, folder)
    old = SlotMap.load(spark, folder)
    new = rebalanced(old, sums, n_shards)
    if (new.shards, new.n_shards) == (old.shards, old.n_shards):
        return old
    new.save(spark, folder)
    return SlotMap.load(spark, folder)


def assign(docs: DataFrame, slots: SlotMap) -> DataFrame:
    """All columns of ``docs`` and ``shard``. The map is broadcast: it has one row a slot."""
    spark, key = docs.sparkSession, "vslot"
    if "shard" in docs.columns:
        docs = docs.withColumnRenamed("shard", "shard_before")
    keyed = docs.select(F.struct("*").alias("row_"), slot_of(F.col("text"), len(slots.shards)).alias(key))
    return keyed.join(F.broadcast(slots.frame(spark).select(key, "shard")), key).select("row_.*", "shard")


def positions(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``slot`` numbers the rows of a shard from 0 on without gaps. Rows are numbered inside one of ``PARTS``
    parts of their virtual slot, and the counts of the parts before it in the same shard are added; so
    neither a shard nor a group of equal rows, be it a third of the table, is ever in one task.
    """
    spark = docs.sparkSession
    slots = edited(spark, folder or storage.new_path(spark, "slot-map"), bytes_by_slot(docs, n_slots), n_shards)
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), checksum(F.col("text")).alias("text_crc32"), slot_of(F.col("text"), n_slots).alias("vslot"))
    rows = storage.staged(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")), "shard-rows")
    counts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(F.broadcast(slots.frame(spark)), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = storage.staged(counts.select("vslot", "part", "shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_")), "shard-starts")
    numbered = rows.withColumn("at_", F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    # At most n_slots * PARTS rows, whatever the size of the table.
    return numbered.join(F.broadcast(starts), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start_") + F.col("at_")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "map_version"
    )


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(storage.table(spark, sf_dir, "documents"), 16)
