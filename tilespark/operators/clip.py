"""Clipping: polygons to pixel edges, scanline spans, the tiles that they touch, and pixel masks.

A scanline meets an edge on rows that follow from the edge itself, so edges are
exploded into rows and everything joins by equal keys; there is no range join.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions import mercator as m


def edges(positions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, polygon, ex0, ey0, ex1, ey1 from keys, z, polygon, ring, nth, lon, lat. Open rings of more than two points close."""
    ring = [*keys, "polygon", "ring"]
    order = Window.partitionBy(*ring).orderBy("nth")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("lon", "lat")
    rows = positions.withColumns({"next_": F.lead(point).over(order), "first_": F.first(point).over(whole), "n_": F.count("*").over(whole)})
    closing = F.when((F.col("n_") > 2) & (F.struct("lon", "lat") != F.col("first_")), F.col("first_"))
    rows = rows.withColumn("to_", F.coalesce("next_", closing)).where("to_ IS NOT NULL")
    z = F.col("z")
    return rows.select(*keys, "polygon", m.lon_to_px(F.col("lon"), z).alias("ex0"), m.lat_to_py(F.col("lat"), z).alias("ey0"), m.lon_to_px(F.col("to_.lon"), z).alias("ex1"), m.lat_to_py(F.col("to_.lat"), z).alias("ey1"))


def crossings(edge_rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, polygon, y, x, x0, x1: where the middle of each pixel row of the window crosses an edge (lower end in, upper end out)."""
    rows = edge_rows.join(windows.select(*keys, "x0", "y0", "x1", "y1"), keys)
    low, high = F.least("ey0", "ey1"), F.greatest("ey0", "ey1")
    rows = rows.withColumns({"from_": F.greatest(F.floor(low - 0.5), F.col("y0")), "to_": F.least(F.ceil(high - 0.5), F.col("y1") - 1)}).where("from_ <= to_")
    rows = rows.withColumn("y", F.explode(F.sequence("from_", "to_"))).withColumn("mid_", F.col("y") + 0.5)
    rows = rows.where((F.col("ey0") <= F.col("mid_")) != (F.col("ey1") <= F.col("mid_")))
    x = F.col("ex0") + (F.col("mid_") - F.col("ey0")) * (F.col("ex1") - F.col("ex0")) / (F.col("ey1") - F.col("ey0"))
    return rows.select(*keys, "polygon", "y", x.alias("x"), "x0", "x1")


def spans(crossed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, polygon, y, from_x, to_x: pixels whose centres are inside, by the even-odd rule, the end excluded."""
    order = Window.partitionBy(*keys, "polygon", "y").orderBy("x")
    pairs = crossed.withColumns({"nth_": F.row_number().over(order), "next_": F.lead("x").over(order)}).where("nth_ % 2 = 1 AND next_ IS NOT NULL")
    cut = pairs.select(*keys, "polygon", "y", F.greatest(F.ceil(F.col("x") - 0.5), F.col("x0")).alias("from_x"), F.least(F.ceil(F.col("next_") - 0.5), F.col("x1")).alias("to_x"))
    return cut.where("from_x < to_x")


def pixels(span_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pixels: how many lie inside any polygon, each counted once. Of a span counts what no span before it in its row reaches."""
    order = Window.partitionBy(*keys, "y").orderBy("from_x")
    reached = F.max("to_x").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = span_rows.select(*keys, F.greatest(F.col("to_x") - F.greatest("from_x", reached), F.lit(0)).alias("fresh_"))
    return fresh.groupBy(*keys).agg(F.sum("fresh_").alias("pixels"))


def touched(span_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y of tiles with a pixel inside."""
    wide = span_rows.select(*keys, F.expr(f"y div {m.TILE}").alias("y"), F.explode(F.sequence(F.expr(f"from_x div {m.TILE}"), F.expr(f"(to_x - 1) div {m.TILE}"))).alias("x"))
    return wide.distinct()


def kept(tiles: DataFrame, span_rows: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.join(touched(span_rows, keys), [*keys, "x", "y"], "left_semi")


def skipped(tiles: DataFrame, span_rows: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.join(touched(span_rows, keys), [*keys, "x", "y"], "left_anti")


def mask(rows: Iterable[tuple[int, int, int]], x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """Which pixels of a window are inside any of the spans (y, from, to): the union of the polygons."""
    inside = np.zeros((height, width), bool)
    for y, a, b in rows:
        if 0 <= y - y0 < height:
            inside[y - y0, max(a - x0, 0) : max(b - x0, 0)] = True
    return inside
