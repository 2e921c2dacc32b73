"""Web Mercator as Column functions: degrees, global pixels, metres, windows, tile ranges.

All inputs and outputs are Columns, so Catalyst keeps every formula inside one
generated stage. Pixel and tile numbers are BIGINT: the world is 2**31 pixels
wide at zoom 23. An area is four DOUBLE columns ``min_lat, min_lon, max_lat,
max_lon``; a window is four BIGINT columns ``x0, y0, x1, y1``, the last two
excluded; a tile range is ``tx0, ty0, tx1, ty1``, all included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the projection.
TILE = 256
MAX_LAT = 85.05112877980659
RADIUS = 6378137.0
ORIGIN_SHIFT = math.pi * RADIUS
METERS_A_DEGREE = 111320.0


def world(z: Column) -> Column:
    """Width of the world in pixels, as a double."""
    return F.pow(F.lit(2.0), z) * float(TILE)


def clamped_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))


def lon_to_px(lon: Column, z: Column) -> Column:
    return (lon + 180.0) / 360.0 * world(z)


def lat_to_py(lat: Column, z: Column) -> Column:
    s = F.sin(clamped_lat(lat) * math.pi / 180.0)
    return (0.5 - F.ln((1.0 + s) / (1.0 - s)) / (4.0 * math.pi)) * world(z)


def px_to_lon(px: Column, z: Column) -> Column:
    return px / world(z) * 360.0 - 180.0


def py_to_lat(py: Column, z: Column) -> Column:
    return F.atan(F.sinh(math.pi - 2.0 * math.pi * py / world(z))) * 180.0 / math.pi


def mercator_resolution(z: Column) -> Column:
    return 2.0 * ORIGIN_SHIFT / world(z)


def px_to_mercator_x(px: Column, z: Column) -> Column:
    return px * mercator_resolution(z) - ORIGIN_SHIFT


def py_to_mercator_y(py: Column, z: Column) -> Column:
    return ORIGIN_SHIFT - py * mercator_resolution(z)


def ground_resolution(lat: Column, z: Column) -> Column:
    return mercator_resolution(z) * F.cos(clamped_lat(lat) * math.pi / 180.0)


def clamp(v: Column, low: Column, high: Column) -> Column:
    """``low`` wins where the bounds cross."""
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def center_lat() -> Column:
    return (F.col("min_lat") + F.col("max_lat")) / 2.0


def padded(areas: DataFrame, meters: Column) -> DataFrame:
    """The areas grown by so many metres each way, within the projection's limits."""
    by_lat = meters / METERS_A_DEGREE
    by_lon = meters / (METERS_A_DEGREE * F.greatest(F.cos(center_lat() * math.pi / 180.0), F.lit(1e-6)))
    return areas.withColumns({
        "min_lat": F.greatest(F.lit(-MAX_LAT + 1e-9), F.col("min_lat") - by_lat),
        "max_lat": F.least(F.lit(MAX_LAT - 1e-9), F.col("max_lat") + by_lat),
        "min_lon": F.greatest(F.lit(-180.0), F.col("min_lon") - by_lon),
        "max_lon": F.least(F.lit(180.0), F.col("max_lon") + by_lon),
    })


def around(points: DataFrame, lat: Column, lon: Column, meters: Column) -> DataFrame:
    """An area around each point: a box without extent, padded."""
    boxes = points.withColumns({"min_lat": lat, "max_lat": lat, "min_lon": lon, "max_lon": lon})
    return padded(boxes, meters)


def windowed(areas: DataFrame, z: Column) -> DataFrame:
    """Adds the pixel window: floor of the north-west corner, ceiling of the south-east, at least one pixel."""
    side = F.call_function("shiftleft", F.lit(TILE).cast("long"), z.cast("int"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    edges = areas.withColumns({
        "x0": clamp(F.floor(lon_to_px(F.col("min_lon"), z)), zero, side - 1),
        "y0": clamp(F.floor(lat_to_py(F.col("max_lat"), z)), zero, side - 1),
        "x1": F.ceil(lon_to_px(F.col("max_lon"), z)),
        "y1": F.ceil(lat_to_py(F.col("min_lat"), z)),
    })
    return edges.withColumns({"x1": clamp(F.col("x1"), F.col("x0") + one, side), "y1": clamp(F.col("y1"), F.col("y0") + one, side)})


def tiled(windows: DataFrame) -> DataFrame:
    """Adds the range of tiles that cover the window, and their number."""
    found = windows.withColumns({"tx0": F.expr(f"x0 div {TILE}"), "ty0": F.expr(f"y0 div {TILE}"), "tx1": F.expr(f"(x1 - 1) div {TILE}"), "ty1": F.expr(f"(y1 - 1) div {TILE}")})
    return found.withColumn("tiles", (F.col("tx1") - F.col("tx0") + 1) * (F.col("ty1") - F.col("ty0") + 1))


def bounded(windows: DataFrame, z: Column) -> DataFrame:
    """Adds the exact geographic bounds of the window: west, south, east, north."""
    return windows.withColumns({"west": px_to_lon(F.col("x0"), z), "south": py_to_lat(F.col("y1"), z), "east": px_to_lon(F.col("x1"), z), "north": py_to_lat(F.col("y0"), z)})


def parent(v: Column, levels: int | Column) -> Column:
    return F.shiftright(v, levels) if isinstance(levels, int) else F.call_function("shiftright", v, levels.cast("int"))


def tile_name(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))


def rounded(v: Column, places: int) -> Column:
    """Half away from zero."""
    return F.round(v, places)
