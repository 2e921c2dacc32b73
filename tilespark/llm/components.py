"""Connected components of a distributed edge list, by alternating large and small stars.

The edges stay a table throughout; each round is a few aggregations and joins, and
its result is written to the shared folder, so a lost executor costs one round. The
least neighbours are written before they are joined: a join that shares an exchange
with its own aggregation could not be split where one node holds most edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import storage

ROUNDS = 60


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def labels(edges: DataFrame) -> DataFrame:
    """node, label: for each node of an edge (u, v) the smallest node of its component."""
    edges = storage.staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = state(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = storage.staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        lower = storage.staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        last, edges = edges, storage.staged(small.where("u <> v").distinct(), "stars")
        for old in (last, large, least, lower):
            storage.forget(old)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
