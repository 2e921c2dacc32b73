"""GeoJSON text to positions, areas and polygons.

The document is a tree of any depth, so one Arrow-batched pass per text flattens
it into rows of positions; everything after that is DataFrame operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import mercator as m
from tilespark.sources import targets

POSITION = "aoi_id long, polygon int, ring int, nth int, lon double, lat double, spread boolean, error string"
#: How deep positions lie in the coordinates of each type.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


class Wrong(ValueError):
    pass


def number(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise TypeError
    return float(v)


def leaves(geometry: dict) -> Iterator[dict]:
    """The geometries that have coordinates, in order; containers may nest."""
    waiting = [geometry]
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            raise Wrong("invalid GeoJSON")
        kind = node.get("type") or ""
        if kind == "FeatureCollection":
            waiting.extend(reversed(node.get("features") or []))
        elif kind == "GeometryCollection":
            waiting.extend(reversed(node.get("geometries") or []))
        elif kind == "Feature":
            if node.get("geometry") is not None:
                waiting.append(node["geometry"])
        elif kind in DEPTH:
            yield node
        else:
            raise Wrong(f'unsupported GeoJSON type "{kind}"' if kind else 'GeoJSON object without a "type"')


def lists(geometry: dict) -> list[list[list]]:
    """Polygons of rings of positions, or such a shape with one polygon for lines and points."""
    kind, found = geometry["type"], geometry.get("coordinates")
    try:
        for _ in range(3 - DEPTH[kind]):
            found = [found]
        return [[[[number(v) for v in p] for p in ring or []] for ring in poly or []] for poly in found or []]
    except TypeError:
        raise Wrong(f"{kind}: bad coordinates") from None


def place(p: list[float]) -> tuple[float, float]:
    if len(p) < 2:
        raise Wrong("position needs at least [lon, lat]")
    lon, lat = p[0], p[1]
    if not -90 <= lat <= 90 or not -180 <= lon <= 180:
        raise Wrong(f"GeoJSON position [{lon:g}, {lat:g}] (GeoJSON order is [lon, lat]): {'latitude' if not -90 <= lat <= 90 else 'longitude'} out of range")
    return lon, lat


def positions_of(text: str | None) -> list[tuple]:
    """(polygon, ring, nth, lon, lat, spread, error); polygon is null outside polygons; one row with an error if the text is wrong."""
    rows: list[tuple] = []
    polygons = 0
    try:
        try:
            root = json.loads(text or "")
        except ValueError:
            raise Wrong("invalid GeoJSON") from None
        for geometry in leaves(root):
            closed, spread = geometry["type"].endswith("Polygon"), geometry["type"] not in ("Point", "MultiPoint")
            for poly in lists(geometry):
                for r, ring in enumerate(poly):
                    for k, p in enumerate(ring):
                        rows.append((polygons if closed else None, r if closed else None, k, *place(p), spread, None))
                polygons += bool(closed and poly)
            if spread and not rows:
                rows.append((None, None, None, None, None, True, None))
    except Wrong as e:
        return [(None, None, None, None, None, None, str(e))]
    if not any(r[3] is not None for r in rows):
        return [(None, None, None, None, None, None, "GeoJSON contains no coordinates")]
    return rows


def flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in POSITION.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(key, *r) for r in positions_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def positions(texts: DataFrame, key: str = "aoi_id", text: str = "geojson") -> DataFrame:
    return texts.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(flattened, POSITION)


def areas(found: DataFrame, radius: Column | None = None) -> DataFrame:
    """aoi_id, kind, min_lat.. max_lon, polygons, error: the extent of each text's positions, padded where it is a point or a line without width."""
    radius = F.lit(targets.DEFAULT_RADIUS) if radius is None else radius
    extent = found.groupBy("aoi_id").agg(
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"), F.countDistinct("polygon").alias("polygons"), F.bool_or("spread").alias("spread_"), F.first("error", ignorenulls=True).alias("error")
    )
    flat = ~F.coalesce("spread_", F.lit(False)) | (F.col("min_lat") == F.col("max_lat")) | (F.col("min_lon") == F.col("max_lon"))
    extent = extent.withColumn("flat_", flat).withColumn("radius_", radius.cast("double"))
    extent = extent.withColumn("error", F.coalesce("error", F.when(F.col("flat_") & (F.col("radius_") <= 0), "radius must be > 0 for point geometries")))
    names = ("min_lat", "min_lon", "max_lat", "max_lon")
    kept = extent.withColumns({f"{c}_b": F.col(c) for c in names})
    out = m.padded(kept, F.col("radius_")).withColumns({c: F.when(F.col("error").isNotNull(), None).when(F.col("flat_"), F.col(c)).otherwise(F.col(f"{c}_b")) for c in names})
    out = out.withColumn("error", F.coalesce("error", targets.error_of_area()))
    return out.select("aoi_id", F.lit("geojson").alias("kind"), *names, "polygons", "error")
