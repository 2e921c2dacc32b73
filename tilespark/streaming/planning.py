"""Planning on a stream of targets. Plans are projections of single rows, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.plans import layout
from tilespark.sources import targets


def planned(texts: DataFrame, radius: Column | None = None, top: int = 23, bottom: int = 1, most: int = layout.DEFAULT_TILES) -> DataFrame:
    """Each valid target of a (streaming) table with ``input``, at each zoom, with window, tile range, chunk grid and whether it fits the budget. Stateless: no watermark is needed."""
    found = targets.parsed(texts, radius)
    good = found.where(F.col("error").isNull() & F.col("min_lat").isNotNull())
    return layout.grid(layout.at_zooms(good, top, bottom)).withColumn("fits", F.col("tiles") <= most)
