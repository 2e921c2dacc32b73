"""Zoom selection: tallies of probed samples, the rules that accept a zoom, and the outcome of each area."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import settings
from tilespark.plans import layout


@dataclass(frozen=True)
class ZoomOptions:
    """Limits of the search; the ranges are checked."""

    max_zoom: int = 23
    min_zoom: int = 1
    max_tiles: int = layout.DEFAULT_TILES
    min_coverage: float = 0.5
    detail_ratio: float = 0.2
    batch: int = layout.BATCH

    def __post_init__(self) -> None:
        settings.check(max_zoom=self.max_zoom, min_zoom=self.min_zoom, max_tiles=self.max_tiles, coverage=self.min_coverage, detail=self.detail_ratio)


def tally(probed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, z, and counts by outcome. ``probed`` has status, error, fatal and verdict of each sample; an error counts as failed whatever the status."""
    good = F.col("error").isNull()
    ok = good & (F.col("status") == "ok")
    return probed.groupBy(*keys, "z").agg(
        F.count("*").alias("sampled"),
        F.count_if(ok).alias("ok"),
        F.count_if(good & (F.col("status") == "missing")).alias("missing"),
        F.count_if(good & (F.col("status") == "placeholder")).alias("placeholder"),
        F.count_if(~good).alias("failed"),
        F.count_if(ok & (F.col("verdict") == "native")).alias("sharp"),
        F.count_if(ok & (F.col("verdict") == "upsampled")).alias("upsampled"),
        F.coalesce(F.bool_or(F.coalesce("fatal", F.lit(False)) & ~good), F.lit(False)).alias("fatal"),
        F.max_by("error", F.when(~good, F.col("nth"))).alias("last_error"),
        F.min_by("error", F.when(F.col("fatal") & ~good, F.col("nth"))).alias("fatal_error"),
    )


def covered(options: ZoomOptions) -> Column:
    return F.col("ok") / F.greatest("sampled", F.lit(1)) >= options.min_coverage


def accepted(options: ZoomOptions) -> Column:
    """Enough samples hold imagery, and not more look stretched than sharp. Ties and all flat accept."""
    sharp = F.lit(True) if options.detail_ratio == 0 else F.col("upsampled") <= F.col("sharp")
    return ~F.col("fatal") & covered(options) & sharp


def reason(options: ZoomOptions) -> Column:
    percent = F.format_string("%.0f", F.col("ok") / F.greatest("sampled", F.lit(1)) * 100.0)
    asked = f"{options.min_coverage * 100:.0f}"
    return (
        F.when(~covered(options), F.concat(F.lit("coverage "), percent, F.lit(f"% < {asked}%")))
        .when(F.col("accepted"), "imagery available")
        .otherwise(F.concat(F.lit("upsampled: "), F.col("upsampled").cast("string"), F.lit(" of "), (F.col("upsampled") + F.col("sharp")).cast("string"), F.lit(" judged samples lack native detail")))
    )


def outcomes(tallies: DataFrame, tops: DataFrame, keys: list[str], options: ZoomOptions) -> DataFrame:
    """keys, top, outcome, zoom, error: one row an area. Outcomes: ok, none, unreachable, fatal, too_large.

    Levels are judged in batches from the top. A batch in which every sample failed ends the search
    before its levels count; within a batch the first fatal or accepted level does.
    """
    levels = tallies.join(tops.where("top IS NOT NULL"), keys).where("z <= top").withColumn("batch", layout.batch_number(F.col("top"), F.col("z"), options.batch)).withColumn("accepted", accepted(options))
    dead = F.bool_and(~F.col("fatal") & (F.col("failed") == F.col("sampled")) & (F.col("sampled") > 0))
    first = F.max(F.when(F.col("fatal") | F.col("accepted"), F.struct("z", "fatal", "fatal_error")))
    batches = levels.groupBy(*keys, "batch").agg(dead.alias("dead"), first.alias("first"), F.max_by("last_error", -F.col("z")).alias("last_error"))
    none = F.lit(None).cast("int")
    refused = F.col("first.fatal")
    event = F.when(F.col("dead"), F.struct(F.lit("unreachable").alias("outcome"), none.alias("zoom"), F.col("last_error").alias("error"))).when(
        F.col("first").isNotNull(), F.struct(F.when(refused, "fatal").otherwise("ok").alias("outcome"), F.when(~refused, F.col("first.z")).cast("int").alias("zoom"), F.when(refused, F.col("first.fatal_error")).alias("error"))
    )
    found = batches.withColumn("event", event).groupBy(*keys).agg(F.min_by("event", F.when(F.col("event").isNotNull(), F.col("batch"))).alias("event"))
    return tops.join(found, keys, "left").select(*keys, "top", F.when(F.col("top").isNull(), "too_large").otherwise(F.coalesce("event.outcome", F.lit("none"))).alias("outcome"), F.col("event.zoom").alias("zoom"), F.col("event.error").alias("error"))


def attempts(levels: DataFrame, tallies: DataFrame, chosen: DataFrame, keys: list[str], options: ZoomOptions) -> DataFrame:
    """keys, z, tiles, counts, accepted, reason: what was tried, from the highest zoom to the accepted one.

    Levels over the budget come first and have no counts; levels probed ahead below the accepted one are left out.
    """
    counts = ["sampled", "ok", "missing", "placeholder", "failed", "sharp", "upsampled"]
    over = levels.join(chosen.select(*keys, "top"), keys).where("top IS NULL OR z > top").select(
        *keys, "z", "tiles", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(False).alias("accepted"), F.concat(F.lit("exceeds tile budget ("), F.col("tiles").cast("string"), F.lit(f" > {options.max_tiles})")).alias("reason")
    )
    judged = tallies.join(chosen, keys).where("z <= top AND NOT fatal").where(F.col("zoom").isNull() | (F.col("z") >= F.col("zoom"))).withColumn("accepted", accepted(options)).withColumn("reason", reason(options))
    probed = judged.join(levels.select(*keys, "z", "tiles"), [*keys, "z"]).select(*keys, "z", "tiles", *counts, "accepted", "reason")
    return over.unionByName(probed)


def search(areas: DataFrame, keys: list[str], probe: Callable[[DataFrame], DataFrame], options: ZoomOptions, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(outcome of each area, tallies): probes batch by batch, and only areas that are undecided.

    ``probe`` takes distinct tiles (z, x, y) and gives status, error, fatal and verdict; ``keep`` stores
    a DataFrame where executors share it and gives it back. At most ceil(levels / batch) rounds.
    """
    levels = keep(layout.at_zooms(areas, options.max_zoom, options.min_zoom), "levels")
    tops = keep(layout.budget_top(levels, keys, options.max_tiles), "tops")
    open_ = levels.join(tops, keys).where("z <= top").withColumn("batch", layout.batch_number(F.col("top"), F.col("z"), options.batch))
    parts = []
    for batch in range(-(-(options.max_zoom - options.min_zoom + 1) // options.batch)):
        wanted = keep(layout.samples(open_.where(F.col("batch") == batch)).select(*keys, "z", "x", "y", "nth"), f"samples-{batch}")
        seen = probe(wanted.select("z", "x", "y").distinct())
        parts.append(keep(tally(wanted.join(seen, ["z", "x", "y"]), keys), f"tally-{batch}"))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        decided = keep(outcomes(every, tops, keys, options), f"outcomes-{batch}")
        left = decided.where("outcome = 'none' AND top IS NOT NULL")
        if not left.limit(1).count():
            break
        open_ = open_.join(left.select(*keys), keys, "left_semi")
    return decided, every
