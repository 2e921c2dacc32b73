"""Mixing sources to target weights, in DataFrame operations only.

Words are summed by source, targets follow from the weights, a source's rate is
its target over its size, and each document is emitted floor(rate) times, plus
once more if a hash of its id, a number in [0, 1), falls below a threshold.

The threshold is the fraction of the rate, moved to that of ``STEPS`` steps at which
the words that the draw takes come nearest to what the target asks for. With the
bare fraction, long texts leave sources of a few dozen documents up to 57 % off
their targets (19 % with some 500 documents, 4 % with 5000); the draw is else the
same, by the hash alone.

Edge cases: a null text has size 0; the null source is a source of its own, last
in order; a null id hashes as the text 'null'; repeated rows get the same number
of copies each; an empty table gives an empty result; a source without words has
rate 0. Other columns are kept by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm import storage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
STEPS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the table of rates is broadcast (under 2 MB); beyond, the join is shuffled and skewed parts are split.
BROADCAST_SOURCES = 20_000
#: Sources that one task ranks and sums; more go in parts by range.
SOURCES_A_PART = 200_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def in_parts(rows: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """``rows`` dealt out to parts by range, with the part's number; staged, so that the number holds."""
    return storage.staged(rows.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), name)


def around(parts: DataFrame, **sums: str) -> DataFrame:
    """part_, and for each name the sum of a column over the parts before, or, if the name ends in ``after``, over those after. One row a part."""
    by = parts.groupBy("part_").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    order = Window.orderBy("part_")
    sides = {n: order.rowsBetween(1, Window.unboundedFollowing) if n.endswith("after") else order.rowsBetween(Window.unboundedPreceding, -1) for n in sums}
    return by.select("part_", *[F.coalesce(F.sum(n).over(side), F.lit(0)).alias(n) for n, side in sides.items()])


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rate: one row a source, from rows of (source, size).

    Filling to a common level L gives each source min(3 * size, L * weight); with sources in order
    of 3 * size / weight, L follows from the sums over those that stop before. Ranks and sums are
    taken within parts by range and added up over the parts, so no task holds all sources.
    """
    by = storage.staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total, count = by.agg(F.sum("source_size"), F.count("*")).first()
    parts = max(1, -(-count // SOURCES_A_PART))
    named = in_parts(by.withColumn("one_", F.lit(1)), [F.col("source").asc_nulls_last()], parts, "mix-by-name")
    rank = F.row_number().over(Window.partitionBy("part_").orderBy(F.col("source").asc_nulls_last()))
    ranked = named.withColumn("nth_", rank).join(F.broadcast(around(named, before="one_")), "part_").withColumn("nth_", F.col("nth_") + F.col("before") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth_") % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "source_size", "nth_", weight.alias("weight_"), (F.col("source_size") * MOST_REPEATS).cast("double").alias("cap_")).withColumn("stop_", F.col("cap_") / F.col("weight_"))
    stops = in_parts(ranked, [F.col("stop_"), F.col("nth_")], parts, "mix-by-stop")
    order = Window.partitionBy("part_").orderBy("stop_", "nth_")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = stops.join(F.broadcast(around(stops, before="cap_", after="weight_")), "part_")
    level = (F.lit(total).cast("double") - F.coalesce(F.sum("cap_").over(before), F.lit(0.0)) - F.col("before")) / (F.sum("weight_").over(after) + F.col("after"))
    first = levels.select("stop_", "nth_", level.alias("level_")).where("level_ <= stop_").agg(F.min(F.struct("stop_", "nth_", "level_"))).first()[0]
    target = F.least(F.col("cap_"), F.lit(first["level_"] if first else None).cast("double") * F.col("weight_"))
    out = stops.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate_", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def step_of(doc_id: Column, seed: str = SEED) -> Column:
    return F.floor(chance(doc_id, seed) * STEPS).cast("int")


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """source, source_size, target, rate_, cut_ from rows of (doc_id, source, size): draw where the step of the hash is below ``cut_``.

    Words are summed by source and step first; what follows has at most STEPS rows a source.
    """
    sums = storage.staged(rows.groupBy("source", step_of(F.col("doc_id"), seed).alias("step_")).agg(F.sum("size").alias("size")), "mix-steps")
    table = storage.staged(rates(sums, weights), "mix-rates")
    upto = Window.partitionBy("source").orderBy("step_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = sums.select("source", (F.col("step_") + 1).alias("cut_"), F.sum("size").over(upto).alias("words_"))
    drawn = drawn.union(table.select("source", F.lit(0), F.lit(0).cast("long")))
    joined = with_rates(drawn, table)
    wished = (F.col("rate_") - F.floor("rate_")) * F.col("source_size")
    best = joined.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words_") - wished).alias("off"), "cut_"))["cut_"].alias("cut_"))
    side = best.withColumnRenamed("source", "key_")
    return storage.staged(table.join(side, F.col("source").eqNullSafe(F.col("key_"))).drop("key_"), "mix-thresholds")


def with_rates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with its source's rate. ``table`` has one row a source and is staged."""
    side = table.withColumnRenamed("source", "source_key_")
    if table.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("source_key_")), "left").drop("source_key_")


def copies(seed: str = SEED) -> Column:
    return F.coalesce(F.floor("rate_") + F.when(step_of(F.col("doc_id"), seed) < F.col("cut_"), 1).otherwise(0), F.lit(0)).cast("int")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row a document."""
    sized = storage.staged(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    return with_rates(sized, thresholds(sized, weights, seed)).withColumn("copies", copies(seed)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix: each document as often as it is taken, with the columns of ``docs``."""
    table = thresholds(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), weights, seed)
    kept = docs.select(F.struct("*").alias("row_"), "doc_id", "source")
    repeated = with_rates(kept, table).withColumn("copies_", copies(seed)).where("copies_ > 0")
    return repeated.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select("row_.*")


def op5_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(storage.table(spark, sf_dir, "documents"))


#: The same law, from the sums by source on: md5 and IEEE doubles agree in both engines.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM by_source
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM ranked
), leveled AS (
  SELECT *, cap / weight AS stop,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (SELECT level FROM leveled WHERE level <= stop ORDER BY stop, nth LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap, (SELECT level FROM chosen) * weight) AS target FROM leveled
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM targets
), stepped AS (
  SELECT doc_id, source, size,
    CAST(floor(CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 * 4096) AS INTEGER) AS step FROM sized
), summed AS (SELECT source, step, sum(size) AS size FROM stepped GROUP BY source, step
), upto AS (
  SELECT source, step + 1 AS cut, CAST(sum(size) OVER (PARTITION BY source ORDER BY step) AS BIGINT) AS words FROM summed UNION ALL SELECT source, 0, 0 FROM targets
), ordered AS (
  SELECT u.source, cut, row_number() OVER (PARTITION BY u.source ORDER BY abs(words - (rate - floor(rate)) * source_size), cut) AS n FROM upto u JOIN rated r ON u.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CAST(floor(rate) + CASE WHEN step < cut THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM stepped s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source JOIN ordered o ON s.source IS NOT DISTINCT FROM o.source AND o.n = 1)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM counted
"""
