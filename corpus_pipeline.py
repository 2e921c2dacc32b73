"""The corpus pipeline: toxicity, near-deduplication, decontamination, mixing, sharding.

Each stage takes the documents that its predecessor kept, as Parquet in the shared
folder, applies one operator of ``tilespark.llm``, and returns a DataFrame; all but
the last return the columns of ``documents``.

Edge cases, by stage. Null texts count as empty. ``toxicity``: empty texts score by the
intercept; without labels of both kinds nothing goes. ``near_dedup``: texts without words
stay, each row; of rows that repeat id and text one stays; different texts that share an
id, or have none, stay unless they are near copies. ``decontamination``: items without id
count, empty ones match nothing. ``mixing``: texts without words are taken by rate like
others and add nothing; the null source is one more source; rows that repeat id and
source are drawn alike. ``sharding``: equal texts, null and empty ones among them, share
a shard. Ties go to the smaller id, then the smaller hash. Empty tables, of documents,
labels or items, give empty results or drop nothing; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilespark.llm import decontamination, mixing, near_dedup, sharding, storage, toxicity

SHARDS = 16


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.rejected(docs, storage.table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_dedup.deduped(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean(docs, storage.table(spark, sf_dir, "benchmark"))


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard; the slot map is kept in the shared folder."""
    slots = sharding.edited(spark, storage.new_path(spark, "slot-map"), sharding.bytes_by_slot(docs), SHARDS)
    return sharding.assign(docs, slots)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", to_target_mix),
    ("sharding", into_shards),
]

#: A learned score and a similarity join have no SQL form; tests hold each stage against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage but the last is written and read again; what it needed besides, and the stage before, are deleted then."""
    docs, since = storage.table(spark, sf_dir, "documents"), storage.mark()
    for name, stage in STAGES[:-1]:
        docs = storage.settled(storage.staged(stage(spark, docs, sf_dir), f"stage-{name}"), since)
    return STAGES[-1][1](spark, docs, sf_dir)
