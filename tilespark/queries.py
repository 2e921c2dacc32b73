"""The registered queries over areas of interest, with the SQL that checks them.

The given tables hold no places, so every query derives synthetic coordinates from
integer keys; offsets keep them off pixel and tile edges. The oracles are written
from the formulas, for another engine, and share no code with the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import labels, settings
from tilespark.functions import mercator as m
from tilespark.operators import clip, gapfill, quality, render, zoom
from tilespark.plans import layout
from tilespark.plans.store import keep
from tilespark.sources import geojson, http, images, synthetic, targets

ZOOMS = (3, 9, 15, 19, 23)
AREAS_A_TASK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return ((key * 7919 + 13) % 16000) / 100.0 - 80.0 + 0.00123


def lon_of(key: Column) -> Column:
    return ((key * 104729 + 29) % 35900) / 100.0 - 179.5 + 0.00077


def places(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    return table(spark, sf_dir, name).select(k.alias("aoi_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (k % 900 + 50).cast("double").alias("radius"))


def areas(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return m.around(places(spark, sf_dir, name, key), F.col("lat"), F.col("lon"), F.col("radius"))


def at(df: DataFrame, zooms: tuple[int, ...] = ZOOMS) -> DataFrame:
    return df.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))


def windows(spark: SparkSession, sf_dir: str, name: str, key: str, zooms: tuple[int, ...] = ZOOMS) -> DataFrame:
    return m.tiled(m.windowed(at(areas(spark, sf_dir, name, key), zooms), F.col("z")))


# Parts of the oracle SQL.

PI = "3.141592653589793e0"
W = "(256e0 * pow(2e0, z))"
LIMIT = "85.05112877980659e0"


def sql_places(name: str, key: str) -> str:
    return f"places AS (SELECT CAST({key} AS BIGINT) AS aoi_id, (({key} * 7919 + 13) % 16000) / 100e0 - 80e0 + 0.00123e0 AS lat, (({key} * 104729 + 29) % 35900) / 100e0 - 179.5e0 + 0.00077e0 AS lon, CAST({key} % 900 + 50 AS DOUBLE) AS radius FROM {name})"


def sql_areas(name: str, key: str) -> str:
    return sql_places(name, key) + (
        f", areas AS (SELECT *, greatest(-{LIMIT} + 1e-9, lat - radius / 111320e0) AS min_lat, least({LIMIT} - 1e-9, lat + radius / 111320e0) AS max_lat,"
        f" greatest(-180e0, lon - radius / (111320e0 * greatest(cos(lat * {PI} / 180e0), 1e-6))) AS min_lon, least(180e0, lon + radius / (111320e0 * greatest(cos(lat * {PI} / 180e0), 1e-6))) AS max_lon FROM places)"
    )


def sql_px(lon: str) -> str:
    return f"(({lon} + 180e0) / 360e0 * {W})"


def sql_py(lat: str) -> str:
    s = f"sin(greatest(-{LIMIT}, least({LIMIT}, {lat})) * {PI} / 180e0)"
    return f"((0.5e0 - ln((1e0 + {s}) / (1e0 - {s})) / (4e0 * {PI})) * {W})"


def sql_windows(source: str, zooms: tuple[int, ...] = ZOOMS) -> str:
    side = "CAST(256 * pow(2, z) AS BIGINT)"
    return (
        f"levels AS (SELECT s.*, z FROM {source} s, (SELECT unnest([{', '.join(map(str, zooms))}]) AS z) t)"
        f", raw AS (SELECT *, {side} AS side, CAST(floor({sql_px('min_lon')}) AS BIGINT) AS a0, CAST(ceil({sql_px('max_lon')}) AS BIGINT) AS a1, CAST(floor({sql_py('max_lat')}) AS BIGINT) AS b0, CAST(ceil({sql_py('min_lat')}) AS BIGINT) AS b1 FROM levels)"
        ", low AS (SELECT *, least(greatest(a0, 0), side - 1) AS x0, least(greatest(b0, 0), side - 1) AS y0 FROM raw)"
        ", wins AS (SELECT *, least(greatest(a1, x0 + 1), side) AS x1, least(greatest(b1, y0 + 1), side) AS y1 FROM low)"
        ", ranges AS (SELECT *, x0 // 256 AS tx0, y0 // 256 AS ty0, (x1 - 1) // 256 AS tx1, (y1 - 1) // 256 AS ty1 FROM wins)"
        ", tiled AS (SELECT *, (tx1 - tx0 + 1) * (ty1 - ty0 + 1) AS tiles FROM ranges)"
    )


def sql_grid(source: str, side: int) -> str:
    per = max(side // 256, 1)
    return f"grid AS (SELECT *, CASE WHEN x1 - x0 <= {side} AND y1 - y0 <= {side} THEN 1 ELSE CAST(ceil((ty1 - ty0 + 1) / {per}e0) AS BIGINT) END AS chunk_rows, CASE WHEN x1 - x0 <= {side} AND y1 - y0 <= {side} THEN 1 ELSE CAST(ceil((tx1 - tx0 + 1) / {per}e0) AS BIGINT) END AS chunk_cols FROM {source})"


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Projection.


@query(f"WITH {sql_places('events', 'event_id')}, l AS (SELECT *, unnest([{', '.join(map(str, ZOOMS))}]) AS z FROM places) SELECT aoi_id, z, round({sql_px('lon')}, 3) AS px, round({sql_py('lat')}, 3) AS py, CAST(floor({sql_px('lon')} / 256) AS BIGINT) AS tx, CAST(floor({sql_py('lat')} / 256) AS BIGINT) AS ty FROM l")
def mercator_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = m.lon_to_px(F.col("lon"), F.col("z")), m.lat_to_py(F.col("lat"), F.col("z"))
    return at(places(spark, sf_dir, "events", "event_id")).select("aoi_id", "z", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"), F.floor(px / 256).alias("tx"), F.floor(py / 256).alias("ty"))


@query(f"WITH l AS (SELECT CAST(event_id AS BIGINT) AS aoi_id, (event_id * 7919) % 1000000 / 1000000e0 AS u, (event_id * 104729) % 1000000 / 1000000e0 AS v, unnest([{', '.join(map(str, ZOOMS))}]) AS z FROM events) SELECT aoi_id, z, round(u * {W} / {W} * 360 - 180, 6) AS lon, round(atan(sinh({PI} - 2 * {PI} * (v * {W}) / {W})) * 180 / {PI}, 6) AS lat FROM l")
def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("long")
    rows = at(table(spark, sf_dir, "events").select(k.alias("aoi_id"), ((k * 7919) % 1000000 / 1000000.0).alias("u"), ((k * 104729) % 1000000 / 1000000.0).alias("v")))
    z = F.col("z")
    return rows.select("aoi_id", "z", F.round(m.px_to_lon(F.col("u") * m.world(z), z), 6).alias("lon"), F.round(m.py_to_lat(F.col("v") * m.world(z), z), 6).alias("lat"))


@query(f"WITH {sql_places('events', 'event_id')}, l AS (SELECT *, unnest([{', '.join(map(str, ZOOMS))}]) AS z FROM places) SELECT aoi_id, z, round({sql_px('lon')} * (2 * {PI} * 6378137 / {W}) - {PI} * 6378137, 3) AS mx, round({PI} * 6378137 - {sql_py('lat')} * (2 * {PI} * 6378137 / {W}), 3) AS my, round(2 * {PI} * 6378137 / {W}, 6) AS resolution FROM l")
def mercator_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    return at(places(spark, sf_dir, "events", "event_id")).select("aoi_id", "z", F.round(m.px_to_mercator_x(m.lon_to_px(F.col("lon"), z), z), 3).alias("mx"), F.round(m.py_to_mercator_y(m.lat_to_py(F.col("lat"), z), z), 3).alias("my"), F.round(m.mercator_resolution(z), 6).alias("resolution"))


@query(f"WITH {sql_places('customer', 'c_custkey')}, l AS (SELECT *, unnest([{', '.join(map(str, ZOOMS))}]) AS z FROM places) SELECT aoi_id, z, round(2 * {PI} * 6378137 / {W} * cos(greatest(-{LIMIT}, least({LIMIT}, lat * 1.1)) * {PI} / 180), 4) AS ground FROM l")
def ground_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at(places(spark, sf_dir, "customer", "c_custkey")).select("aoi_id", "z", m.rounded(m.ground_resolution(F.col("lat") * 1.1, F.col("z")), 4).alias("ground"))


@query(f"WITH {sql_areas('customer', 'c_custkey')} SELECT aoi_id, round(min_lat, 9) AS min_lat, round(min_lon, 9) AS min_lon, round(max_lat, 9) AS max_lat, round(max_lon, 9) AS max_lon, round((min_lat + max_lat) / 2, 9) AS center_lat FROM areas")
def point_box_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir, "customer", "c_custkey").select("aoi_id", *[F.round(c, 9).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")], F.round(m.center_lat(), 9).alias("center_lat"))


@query(f"WITH {sql_areas('customer', 'c_custkey')}, {sql_windows('areas')} SELECT aoi_id, z, x0, y0, x1, y1, x1 - x0 AS width, y1 - y0 AS height FROM wins")
def pixel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir, "customer", "c_custkey").select("aoi_id", "z", "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


@query(f"WITH {sql_areas('customer', 'c_custkey')}, {sql_windows('areas')} SELECT aoi_id, z, round(x0 / {W} * 360 - 180, 6) AS west, round(x1 / {W} * 360 - 180, 6) AS east, round(atan(sinh({PI} - 2 * {PI} * y0 / {W})) * 180 / {PI}, 6) AS north, round(atan(sinh({PI} - 2 * {PI} * y1 / {W})) * 180 / {PI}, 6) AS south FROM wins")
def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.bounded(windows(spark, sf_dir, "customer", "c_custkey"), F.col("z"))
    return found.select("aoi_id", "z", *[F.round(c, 6).alias(c) for c in ("west", "east", "north", "south")])


@query(f"WITH {sql_areas('customer', 'c_custkey')}, {sql_windows('areas')} SELECT aoi_id, z, tx0, ty0, tx1, ty1, tiles FROM tiled")
def tile_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir, "customer", "c_custkey").select("aoi_id", "z", "tx0", "ty0", "tx1", "ty1", "tiles")


@query(f"WITH {sql_places('events', 'event_id')}, base AS (SELECT 17 AS z, CAST(floor({sql_px('lon').replace('z', '17')} / 256) AS BIGINT) AS x, CAST(floor({sql_py('lat').replace('z', '17')} / 256) AS BIGINT) AS y FROM places), up AS (SELECT unnest([0, 1, 4, 9, 14]) AS n) SELECT CAST(n AS INTEGER) AS up, concat_ws('/', 17 - n, x >> n, y >> n) AS tile, count(*) AS places FROM base, up GROUP BY ALL".replace("pow(2e0, 17)", "pow(2e0, 17)"))
def tile_parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(17)
    base = places(spark, sf_dir, "events", "event_id").select(F.floor(m.lon_to_px(F.col("lon"), z) / 256).alias("x"), F.floor(m.lat_to_py(F.col("lat"), z) / 256).alias("y"))
    rows = base.withColumn("up", F.explode(F.array(*[F.lit(n) for n in (0, 1, 4, 9, 14)])))
    return rows.groupBy("up", m.tile_name(z - F.col("up"), m.parent(F.col("x"), F.col("up")), m.parent(F.col("y"), F.col("up"))).alias("tile")).agg(F.count("*").alias("places"))


# Targets.


def target_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, boxes with corners in any order, and wrong inputs, by order key."""
    k = F.col("o_orderkey").cast("long")
    a, b = k * 37 % 170 - 85, k * 53 % 358 - 179
    part = lambda v: v.cast("string")
    text = (
        F.when(k % 9 == 0, F.concat(part(a), F.lit(","), part(b)))
        .when(k % 9 == 1, F.concat(part(a), F.lit("; "), part(b)))
        .when(k % 9 == 2, F.concat(part(a), F.lit(" "), part(b), F.lit(" "), part(a + 1), F.lit(","), part(b + 1)))
        .when(k % 9 == 3, F.concat(part(a + 2), F.lit(","), part(b + 2), F.lit(","), part(a), F.lit(","), part(b)))
        .when(k % 9 == 4, F.concat(part(a), F.lit(","), part(b), F.lit(",1")))
        .when(k % 9 == 5, F.concat(part(a + 200), F.lit(","), part(b)))
        .when(k % 9 == 6, F.concat(part(a), F.lit(","), part(b + 400)))
        .when(k % 9 == 7, F.concat(F.lit("area"), part(k), F.lit(".geojson")))
        .otherwise(F.concat(part(a), F.lit(","), part(b), F.lit(","), part(a), F.lit(","), part(b + 1)))
    )
    return table(spark, sf_dir, "orders").select(k.alias("aoi_id"), text.alias("input"), (k % 7 * 50.0 - 50.0).alias("radius"))


@query(f"""
WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS aoi_id, o_orderkey % 9 AS c, o_orderkey * 37 % 170 - 85 AS a, o_orderkey * 53 % 358 - 179 AS b, CAST(o_orderkey % 7 * 50 - 50 AS DOUBLE) AS radius FROM orders),
n AS (SELECT *, CASE c WHEN 5 THEN a + 200 ELSE a END AS la, CASE c WHEN 6 THEN b + 400 ELSE b END AS lo,
  CASE c WHEN 2 THEN a + 1 WHEN 3 THEN a + 2 ELSE a END AS la2, CASE c WHEN 2 THEN b + 1 WHEN 3 THEN b + 2 WHEN 8 THEN b + 1 ELSE b END AS lo2,
  CASE WHEN c IN (2, 3, 8) THEN 'bbox' WHEN c IN (0, 1, 5, 6) THEN 'point' WHEN c = 7 THEN 'file' END AS kind FROM k),
e AS (SELECT *, CASE WHEN c = 4 THEN 'expected 2 numbers (lat,lon) or 4 numbers (lat1,lon1,lat2,lon2), got 3' WHEN c = 7 THEN NULL
  WHEN la < -90 OR la > 90 OR la2 < -90 OR la2 > 90 AND c IN (2, 3, 8) THEN 'latitude out of range; coordinates are lat,lon' WHEN lo < -180 OR lo > 180 OR lo2 < -180 OR lo2 > 180 AND c IN (2, 3, 8) THEN 'longitude out of range [-180, 180]'
  WHEN kind = 'point' AND radius <= 0 THEN 'radius must be > 0 for a point target' END AS first_error FROM n),
b AS (SELECT *, CASE WHEN first_error IS NULL AND kind IN ('point', 'bbox') THEN 1 END AS good,
  least(la, la2) AS s, greatest(la, la2) AS t, least(lo, lo2) AS u, greatest(lo, lo2) AS v FROM e),
p AS (SELECT *, CASE WHEN good = 1 THEN CASE WHEN kind = 'point' THEN greatest(-{LIMIT} + 1e-9, s - radius / 111320e0) ELSE CAST(s AS DOUBLE) END END AS min_lat,
  CASE WHEN good = 1 THEN CASE WHEN kind = 'point' THEN least({LIMIT} - 1e-9, t + radius / 111320e0) ELSE CAST(t AS DOUBLE) END END AS max_lat,
  CASE WHEN good = 1 THEN CASE WHEN kind = 'point' THEN greatest(-180e0, u - radius / (111320e0 * greatest(cos(s * {PI} / 180e0), 1e-6))) ELSE CAST(u AS DOUBLE) END END AS min_lon,
  CASE WHEN good = 1 THEN CASE WHEN kind = 'point' THEN least(180e0, v + radius / (111320e0 * greatest(cos(s * {PI} / 180e0), 1e-6))) ELSE CAST(v AS DOUBLE) END END AS max_lon FROM b)
SELECT aoi_id, kind, round(min_lat, 9) AS min_lat, round(min_lon, 9) AS min_lon, round(max_lat, 9) AS max_lat, round(max_lon, 9) AS max_lon,
  coalesce(first_error, CASE WHEN good IS NULL THEN NULL WHEN min_lat >= max_lat OR min_lon >= max_lon THEN 'bounding box has zero area (check coordinate order: lat,lon)' WHEN min_lat <= -{LIMIT} OR max_lat >= {LIMIT} THEN 'latitude beyond Web Mercator limit' END) AS error FROM p
""")
def target_parse_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.parsed(target_texts(spark, sf_dir), F.col("radius"))
    return found.select("aoi_id", "kind", *[F.round(c, 9).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")], "error")


@query(f"""
WITH b AS (SELECT CAST(o_orderkey AS BIGINT) AS aoi_id, CASE o_orderkey % 8 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN -91e0 WHEN 2 THEN -88e0 ELSE (o_orderkey % 120) - 60e0 END AS min_lat,
  CASE o_orderkey % 8 WHEN 3 THEN -181e0 ELSE (o_orderkey % 300) - 150e0 END AS min_lon, o_orderkey % 8 AS c FROM orders),
d AS (SELECT *, CASE c WHEN 4 THEN min_lat WHEN 5 THEN 'Infinity'::DOUBLE ELSE min_lat + 1 END AS max_lat, CASE c WHEN 6 THEN min_lon - 1 ELSE min_lon + 1 END AS max_lon FROM b)
SELECT aoi_id, CASE WHEN c IN (0, 5) THEN 'coordinates must be finite numbers' WHEN min_lat < -90 OR max_lat > 90 THEN 'latitude out of range [-90, 90]' WHEN min_lon < -180 OR max_lon > 180 THEN 'longitude out of range [-180, 180]'
  WHEN min_lat >= max_lat OR min_lon >= max_lon THEN 'bounding box has zero area (check coordinate order: lat,lon)' WHEN min_lat <= -{LIMIT} OR max_lat >= {LIMIT} THEN 'latitude beyond Web Mercator limit' END AS error FROM d
""")
def bbox_validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    c = k % 8
    low = F.when(c == 0, float("nan")).when(c == 1, -91.0).when(c == 2, -88.0).otherwise(k % 120 - 60.0)
    west = F.when(c == 3, -181.0).otherwise(k % 300 - 150.0)
    rows = table(spark, sf_dir, "orders").select(k.alias("aoi_id"), c.alias("c"), low.alias("min_lat"), west.alias("min_lon"))
    rows = rows.withColumns({"max_lat": F.when(F.col("c") == 4, F.col("min_lat")).when(F.col("c") == 5, float("inf")).otherwise(F.col("min_lat") + 1), "max_lon": F.when(F.col("c") == 6, F.col("min_lon") - 1).otherwise(F.col("min_lon") + 1)})
    return rows.select("aoi_id", targets.error_of_area().alias("error"))


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a run, most of them right, by part key."""
    k = F.col("p_partkey").cast("long")
    odd = lambda n, wrong, good: F.when(k % 23 == n, wrong).otherwise(good)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), odd(1, 24, k % 24).cast("int").alias("max_zoom"), odd(2, 25, 0).cast("int").alias("min_zoom"), odd(3, 0, k % 100 + 1).cast("int").alias("quality"), odd(4, 65, k % 64 + 1).cast("int").alias("workers"),
        odd(5, 0, k + 1).cast("long").alias("max_tiles"), F.when(k % 23 == 6, 255).when(k % 23 == 10, 16384).otherwise(256 + k % 1000).cast("int").alias("chunk"), odd(7, 1.5, (k % 10 + 1) / 10.0).cast("double").alias("coverage"), odd(8, -0.1, 0.2).cast("double").alias("detail"), odd(9, "http://h/{z}/{x}", "http://h/{z}/{x}/{y}").alias("url"), F.when(k % 23 == 10, "webp").otherwise("png").alias("format"),
    )


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 23 WHEN 1 THEN '-zoom must be 0-23' WHEN 2 THEN '-min-zoom must be between 0 and -zoom' WHEN 3 THEN '-q must be 1-100' WHEN 4 THEN '-j must be 1-64' WHEN 5 THEN '-max-tiles must be positive'
 WHEN 6 THEN '-chunk must be at least 256' WHEN 7 THEN '-coverage must be in (0, 1]' WHEN 8 THEN '-detail must be >= 0' WHEN 9 THEN '-url must contain {z}, {x} and {y}' WHEN 10 THEN '-chunk exceeds the longest side of the format' END AS error FROM part""")
def settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each row of settings breaks, by the rules that runs are held to."""
    return run_settings(spark, sf_dir).select("id", settings.error_column(**{c: F.col(c) for c in settings.DEFAULTS}).alias("error"))


def geojson_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FeatureCollection for each nation: a polygon, a line, or points alone."""
    k = F.col("n_nationkey").cast("long")
    x, y = (k * 13 % 300 - 150).cast("string"), (k * 7 % 120 - 60).cast("string")
    x2, y2 = (k * 13 % 300 - 150 + 2).cast("string"), (k * 7 % 120 - 60 + 1).cast("string")
    polygon = F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s,9],[%s,%s],[%s,%s]]]}', x, y, x2, y, x2, y2, x, y)
    line = F.format_string('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[%s,%s],[%s,%s]]}]}', x, y, x, y2)
    point = F.format_string('{"type":"MultiPoint","coordinates":[[%s,%s]]}', x, y)
    shape = F.when(k % 3 == 0, polygon).when(k % 3 == 1, line).otherwise(point)
    return table(spark, sf_dir, "nation").select(k.alias("aoi_id"), F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null},{"type":"Feature","geometry":'), shape, F.lit("}]}")).alias("geojson"))


@query(f"""
WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS aoi_id, n_nationkey % 3 AS c, CAST(n_nationkey * 13 % 300 - 150 AS DOUBLE) AS x, CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) AS y FROM nation),
e AS (SELECT *, CASE WHEN c = 0 THEN x + 2 ELSE x END AS x2, CASE WHEN c = 2 THEN y ELSE y + 1 END AS y2, CASE WHEN c = 0 THEN 0e0 ELSE 200e0 END AS r FROM k)
SELECT aoi_id, round(y - r / 111320e0, 9) AS min_lat, round(x - r / (111320e0 * cos((y + y2) / 2 * {PI} / 180)), 9) AS min_lon, round(y2 + r / 111320e0, 9) AS max_lat, round(x2 + r / (111320e0 * cos((y + y2) / 2 * {PI} / 180)), 9) AS max_lon,
  CAST(CASE WHEN c = 0 THEN 1 ELSE 0 END AS BIGINT) AS polygons, CAST(NULL AS VARCHAR) AS error FROM e
""")
def geojson_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geojson.areas(geojson.positions(geojson_texts(spark, sf_dir)))
    return found.select("aoi_id", *[F.round(c, 9).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")], "polygons", "error")


# Planning.


@query(f"""
WITH {sql_areas('supplier', 's_suppkey')}, {sql_windows('areas', tuple(range(23, 0, -1)))}, {sql_grid('tiled', 8192)},
stops AS (SELECT aoi_id, coalesce(max(CASE WHEN tiles <= 1 THEN z END), 1) AS last FROM grid GROUP BY aoi_id)
SELECT g.aoi_id, z, round(2 * {PI} * 6378137 / {W} * cos((min_lat + max_lat) / 2 * {PI} / 180), 3) AS meters_a_pixel, tiles, x1 - x0 AS width, y1 - y0 AS height, chunk_rows * chunk_cols AS images, CASE WHEN tiles > 20000 THEN 'over budget' ELSE '' END AS note
FROM grid g JOIN stops s ON g.aoi_id = s.aoi_id AND z >= last
""")
def dry_run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.dry_run(areas(spark, sf_dir, "supplier", "s_suppkey"), ["aoi_id"])
    return found.withColumn("meters_a_pixel", F.round("meters_a_pixel", 3))


@query(f"WITH {sql_areas('supplier', 's_suppkey')}, {sql_windows('areas', (17,))}, ys AS (SELECT aoi_id, tx0, tx1, unnest(generate_series(ty0, ty1)) AS y FROM tiled) SELECT aoi_id, y, unnest(generate_series(tx0, tx1)) AS x FROM ys")
def tile_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tiles(windows(spark, sf_dir, "supplier", "s_suppkey", (17,))).select("aoi_id", "y", "x")


@query(f"""
WITH {sql_areas('customer', 'c_custkey')}, {sql_windows('areas')},
xs AS (SELECT DISTINCT aoi_id, z, unnest([tx0, (tx0 + tx1) // 2, tx1]) AS x FROM tiled), ys AS (SELECT DISTINCT aoi_id, z, unnest([ty0, (ty0 + ty1) // 2, ty1]) AS y FROM tiled)
SELECT aoi_id, z, x, y FROM xs JOIN ys USING (aoi_id, z)
""")
def sample_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.samples(windows(spark, sf_dir, "customer", "c_custkey")).select("aoi_id", "z", "x", "y")


@query(f"WITH {sql_areas('customer', 'c_custkey')}, {sql_windows('areas', tuple(range(23, 11, -1)))} SELECT aoi_id, max(CASE WHEN tiles <= 200 THEN z END) AS top FROM tiled GROUP BY aoi_id")
def budget_top_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.budget_top(layout.at_zooms(areas(spark, sf_dir, "customer", "c_custkey"), 23, 12), ["aoi_id"], 200)


def big_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.around(places(spark, sf_dir, "nation", "n_nationkey"), F.col("lat"), F.col("lon"), F.col("radius") * 10)


def sql_big(zooms: tuple[int, ...]) -> str:
    return sql_areas("nation", "n_nationkey").replace("CAST(n_nationkey % 900 + 50 AS DOUBLE)", "CAST((n_nationkey % 900 + 50) * 10 AS DOUBLE)") + ", " + sql_windows("areas", zooms)


SQL_CHUNKS = """cells AS (SELECT *, unnest(generate_series(0, chunk_rows - 1)) AS chunk_row FROM grid), cells2 AS (SELECT *, unnest(generate_series(0, chunk_cols - 1)) AS chunk_col FROM cells),
rng AS (SELECT *, CASE WHEN chunk_rows * chunk_cols = 1 THEN tx0 ELSE tx0 + chunk_col * 8 END AS cx, CASE WHEN chunk_rows * chunk_cols = 1 THEN ty0 ELSE ty0 + chunk_row * 8 END AS cy,
  CASE WHEN chunk_rows * chunk_cols = 1 THEN tx1 ELSE least(tx0 + chunk_col * 8 + 7, tx1) END AS dx, CASE WHEN chunk_rows * chunk_cols = 1 THEN ty1 ELSE least(ty0 + chunk_row * 8 + 7, ty1) END AS dy FROM cells2)"""


@query(f"WITH {sql_big((13, 15, 17))}, {sql_grid('tiled', 2048)}, {SQL_CHUNKS} SELECT aoi_id, z, chunk_row, chunk_col, greatest(x0, cx * 256) AS cx0, greatest(y0, cy * 256) AS cy0, least(x1, (dx + 1) * 256) AS cx1, least(y1, (dy + 1) * 256) AS cy1 FROM rng")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.chunks(m.tiled(m.windowed(at(big_areas(spark, sf_dir), (13, 15, 17)), F.col("z"))), 2048)
    return found.select("aoi_id", "z", "chunk_row", "chunk_col", "cx0", "cy0", "cx1", "cy1")


@query(f"WITH {sql_big((17,))}, {sql_grid('tiled', 2048)}, {SQL_CHUNKS} SELECT aoi_id, CASE WHEN chunk_rows * chunk_cols = 1 THEN '' ELSE '_r' || lpad(CAST(chunk_row AS VARCHAR), CAST(greatest(2, length(CAST(chunk_rows - 1 AS VARCHAR))) AS INTEGER), '0') || '_c' || lpad(CAST(chunk_col AS VARCHAR), CAST(greatest(2, length(CAST(chunk_cols - 1 AS VARCHAR))) AS INTEGER), '0') END AS suffix FROM rng")
def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.chunks(m.tiled(m.windowed(at(big_areas(spark, sf_dir), (17,)), F.col("z"))), 2048).select("aoi_id", "suffix")


@query(f"""
WITH {sql_big((15,))}, {sql_grid('tiled', 2048)}, {SQL_CHUNKS}, ys AS (SELECT *, unnest(generate_series(ty0, ty1)) AS y FROM grid), t AS (SELECT *, unnest(generate_series(tx0, tx1)) AS x FROM ys)
SELECT t.aoi_id, t.x, t.y, rng.chunk_row, rng.chunk_col FROM t JOIN rng ON t.aoi_id = rng.aoi_id AND t.x BETWEEN rng.cx AND rng.dx AND t.y BETWEEN rng.cy AND rng.dy
""")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.tiles(m.tiled(m.windowed(at(big_areas(spark, sf_dir), (15,)), F.col("z"))))
    return layout.chunk_of(found, 2048).select("aoi_id", "x", "y", "chunk_row", "chunk_col")


@query(f"""
WITH {sql_areas('supplier', 's_suppkey')}, {sql_windows('areas', (17,))}, ys AS (SELECT *, unnest(generate_series(ty0, ty1)) AS y FROM tiled), t AS (SELECT *, unnest(generate_series(tx0, tx1)) AS x FROM ys)
SELECT aoi_id, x, y, greatest(x * 256, x0) - x0 AS px0, greatest(y * 256, y0) - y0 AS py0, least(x * 256 + 256, x1) - x0 AS px1, least(y * 256 + 256, y1) - y0 AS py1, greatest(x0 - x * 256, 0) AS ox, greatest(y0 - y * 256, 0) AS oy FROM t
""")
def tile_canvas_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.tiles(windows(spark, sf_dir, "supplier", "s_suppkey", (17,))).withColumns({"cx0": F.col("x0"), "cy0": F.col("y0"), "cx1": F.col("x1"), "cy1": F.col("y1")})
    return layout.placed(found).select("aoi_id", "x", "y", "px0", "py0", "px1", "py1", "ox", "oy")


# Labels, addresses, sizes.


@query("""SELECT CAST(event_id AS BIGINT) AS id, u || CASE WHEN event_id % 3 = 0 THEN '' ELSE CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'token=a+b%26' || event_id END AS url, u || CASE WHEN event_id % 3 = 0 THEN '' ELSE CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'token=REDACTED' END AS shown
FROM (SELECT *, 'https://h/' || (event_id % 20) || '/' || (event_id * 7) || '/' || (event_id * 3) || CASE WHEN event_id % 2 = 0 THEN '.png?style=1' ELSE '' END AS u FROM events)""")
def tile_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("long")
    rows = table(spark, sf_dir, "events").select(k.alias("id"), F.when(k % 2 == 0, "https://h/{z}/{y}/{x}.png?style=1").otherwise("https://h/{z}/{y}/{x}").alias("template"), F.when(k % 3 != 0, F.concat(F.lit("a b&"), k.cast("string"))).alias("token"))
    url = labels.tile_url(F.col("template"), F.col("id") % 20, F.col("id") * 3, F.col("id") * 7, F.col("token"))
    return rows.select("id", url.alias("url")).select("id", "url", labels.redacted(F.col("url")).alias("shown"))


def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, nth, n: decimal, as from a key of 3 036 996 on n may be beyond 64 bits, where the oracle SQL ends with an error."""
    k, nth = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int")
    factor = F.when(nth % 3 == 0, 1).when(nth % 3 == 1, 997).otherwise(1000003)
    wide, fits = k.cast("decimal(19,0)"), F.try_add(F.try_multiply(F.try_multiply(k, k), factor), nth)
    n = F.coalesce(fits.cast("decimal(38,0)"), (wide * wide * factor + nth).cast("decimal(38,0)"))
    return table(spark, sf_dir, "lineitem").select(k.alias("k"), nth.alias("nth"), n.alias("n"))


@query("""WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INTEGER) AS nth, CAST(l_orderkey * l_orderkey * (CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 997 ELSE 1000003 END) + l_linenumber AS BIGINT) AS n FROM lineitem)
SELECT k, nth, CASE WHEN n >= 1073741824 THEN format('{:.2f} GB', n / 1073741824e0) WHEN n >= 1048576 THEN format('{:.1f} MB', n / 1048576e0) WHEN n >= 1024 THEN CAST(CAST(round_even(n / 1024e0, 0) AS BIGINT) AS VARCHAR) || ' KB' ELSE n || ' B' END AS size FROM l""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_counts(spark, sf_dir).select("k", "nth", labels.human_bytes(F.col("n")).alias("size"))


@query("""WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 6 WHEN 0 THEN 'a.webp' WHEN 1 THEN 'd.x/b.JPG' WHEN 2 THEN 'c.jpeg' WHEN 3 THEN 'e.png' WHEN 4 THEN 'd.x/noext' ELSE 'f.tif' END AS path FROM nation)
SELECT k, CASE k % 6 WHEN 0 THEN '.webp' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png' WHEN 4 THEN '' ELSE '.tif' END AS extension, CASE k % 6 WHEN 0 THEN 'webp' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'png' END AS format,
  CAST(CASE k % 6 WHEN 0 THEN 16383 WHEN 1 THEN 65535 WHEN 2 THEN 65535 WHEN 3 THEN 1048576 END AS INTEGER) AS longest, CASE k % 6 WHEN 0 THEN '.wld' WHEN 1 THEN '.jgw' WHEN 2 THEN '.jgw' WHEN 3 THEN '.pgw' END AS world FROM l""")
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    path = F.element_at(F.array(*[F.lit(p) for p in ("a.webp", "d.x/b.JPG", "c.jpeg", "e.png", "d.x/noext", "f.tif")]), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), labels.extension(path).alias("extension"), labels.format_of(path).alias("format"))
    return rows.select("k", "extension", "format", F.when(F.col("format").isNotNull(), labels.longest_side(F.col("format"))).alias("longest"), F.when(F.col("format").isNotNull(), labels.world_file_extension(F.col("format"))).alias("world"))


@query(f"WITH {sql_areas('nation', 'n_nationkey')}, {sql_windows('areas', (19,))}, r AS (SELECT *, 2 * {PI} * 6378137 / {W} AS res FROM wins) SELECT aoi_id, format('{{:.10f}}', res) || chr(10) || '0.0' || chr(10) || '0.0' || chr(10) || format('{{:.10f}}', -res) || chr(10) || format('{{:.6f}}', (x0 + 0.5e0) * res - {PI} * 6378137) || chr(10) || format('{{:.6f}}', {PI} * 6378137 - (y0 + 0.5e0) * res) || chr(10) AS body FROM r")
def world_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir, "nation", "n_nationkey", (19,)).select("aoi_id", images.world_file(F.col("x0"), F.col("y0"), F.col("z")).alias("body"))


@query("""WITH a AS (SELECT CAST(event_id AS BIGINT) AS id, n, CASE (event_id * 31 + n * n * 17) % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 ELSE 429 END AS code,
  CASE (event_id + n) % 5 WHEN 0 THEN 7e0 WHEN 1 THEN 30e0 ELSE 0e0 END AS asked FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS n)),
f AS (SELECT id, min(CASE WHEN code NOT IN (429, 503) THEN n END) AS stop FROM a GROUP BY id),
w AS (SELECT a.id, sum(CASE WHEN asked > 0 THEN asked ELSE 0.2e0 * (1 << n) END) AS waited FROM a JOIN f ON a.id = f.id AND n < coalesce(stop, 4) GROUP BY a.id)
SELECT f.id, CAST(coalesce(stop + 1, 5) AS INTEGER) AS requests, CASE WHEN stop IS NULL THEN 'failed' WHEN code = 200 THEN 'ok' WHEN code = 404 THEN 'missing' ELSE 'fatal' END AS outcome,
  round(coalesce(waited, 0e0), 3) AS least_wait FROM f LEFT JOIN a ON a.id = f.id AND a.n = f.stop LEFT JOIN w ON w.id = f.id""")
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client makes of servers' answers, of which some name a time to wait, with the least of its random waits."""
    k = F.col("event_id").cast("long")
    nth = F.sequence(F.lit(0), F.lit(labels.RETRIES))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    codes = F.transform(nth, lambda n: pick((200, 404, 403, 503, 429, 429, 429), (k * 31 + n * n * 17) % 7))
    asked = F.transform(nth, lambda n: pick(("7", " 90 ", "soon", "0", None), (k + n) % 5))
    played = http.outcomes(table(spark, sf_dir, "events").select(k.alias("id"), codes.alias("codes"), asked.alias("asked")), lambda *a: labels.wait_bounds(*a)[0])
    return played.select("id", "requests", "outcome", F.round("waited", 3).alias("least_wait"))


# Zoom selection, on a table of sample outcomes.

OPTIONS = zoom.ZoomOptions(max_zoom=20, min_zoom=12, max_tiles=2000)


def probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(levels, samples with made-up outcomes) of suppliers' areas: imagery ends, thins or fails at a zoom that the key decides."""
    levels = layout.at_zooms(m.around(places(spark, sf_dir, "supplier", "s_suppkey"), F.col("lat"), F.col("lon"), F.col("radius") * 4), OPTIONS.max_zoom, OPTIONS.min_zoom)
    some = layout.samples(levels).select("aoi_id", "z", "x", "y", "nth")
    h = (F.col("aoi_id") * 7 + F.col("z") * 5 + F.col("nth") * 3) % 10
    c = F.col("aoi_id") % 6
    end = F.col("aoi_id") % 7 + 13
    error = F.when((c == 4) & (F.col("z") >= 15), "timed out").when((c == 5) & (F.col("z") == end) & (F.col("nth") == 0), "refused").when((c == 3) & (h < 2), "timed out")
    status = F.when(F.col("z") > end, F.when(h < 5, "missing").otherwise("placeholder")).otherwise("ok")
    verdict = F.when(F.col("z") == end, F.when(h < 6, "upsampled").otherwise("native")).otherwise(F.when(h < 2, "inconclusive").otherwise("native"))
    some = some.withColumns({"error": error, "status": F.when(error.isNull(), status).otherwise("missing"), "fatal": error == "refused", "verdict": F.when(error.isNull() & (status == "ok"), verdict)})
    return levels, some


SQL_PROBED = f"""
{sql_areas('supplier', 's_suppkey').replace('CAST(s_suppkey % 900 + 50 AS DOUBLE)', 'CAST((s_suppkey % 900 + 50) * 4 AS DOUBLE)')}, {sql_windows('areas', tuple(range(20, 11, -1)))},
cand AS (SELECT aoi_id, z, unnest([0, 0, 0, 3, 3, 3, 6, 6, 6]) AS r, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS c, unnest([ty0, ty0, ty0, (ty0 + ty1) // 2, (ty0 + ty1) // 2, (ty0 + ty1) // 2, ty1, ty1, ty1]) AS y, unnest([tx0, (tx0 + tx1) // 2, tx1, tx0, (tx0 + tx1) // 2, tx1, tx0, (tx0 + tx1) // 2, tx1]) AS x FROM tiled),
firsts AS (SELECT aoi_id, z, x, y, min(r) AS r, min(c) AS c FROM cand GROUP BY ALL),
samples AS (SELECT aoi_id, z, x, y, 3 * (dense_rank() OVER (PARTITION BY aoi_id, z ORDER BY r) - 1) + dense_rank() OVER (PARTITION BY aoi_id, z ORDER BY c) - 1 AS nth FROM firsts),
seen AS (SELECT *, (aoi_id * 7 + z * 5 + nth * 3) % 10 AS h, aoi_id % 7 + 13 AS ends, CASE WHEN aoi_id % 6 = 4 AND z >= 15 THEN 'timed out' WHEN aoi_id % 6 = 5 AND z = aoi_id % 7 + 13 AND nth = 0 THEN 'refused' WHEN aoi_id % 6 = 3 AND (aoi_id * 7 + z * 5 + nth * 3) % 10 < 2 THEN 'timed out' END AS error FROM samples),
tal AS (SELECT aoi_id, z, count(*) AS sampled, count(*) FILTER (error IS NULL AND z <= ends) AS ok, count(*) FILTER (error IS NULL AND z > ends AND h < 5) AS missing, count(*) FILTER (error IS NULL AND z > ends AND h >= 5) AS placeholder, count(error) AS failed,
  count(*) FILTER (error IS NULL AND (z = ends AND h >= 6 OR z < ends AND h >= 2)) AS sharp, count(*) FILTER (error IS NULL AND z = ends AND h < 6) AS upsampled, coalesce(bool_or(error = 'refused'), false) AS fatal, arg_max(error, nth) FILTER (error IS NOT NULL) AS last_error, arg_min(error, nth) FILTER (error = 'refused') AS fatal_error FROM seen GROUP BY aoi_id, z)
"""


@query(f"WITH {SQL_PROBED} SELECT aoi_id, z, sampled, ok, missing, placeholder, failed, sharp, upsampled, fatal, last_error, fatal_error FROM tal")
def probe_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoom.tally(probed(spark, sf_dir)[1], ["aoi_id"])


SQL_OUTCOME = """
tops AS (SELECT aoi_id, max(CASE WHEN tiles <= 2000 THEN z END) AS top FROM tiled GROUP BY aoi_id),
lev AS (SELECT tal.*, top, (top - z) // 3 AS batch, NOT fatal AND ok >= 0.5 * sampled AND upsampled <= sharp AS accepted FROM tal JOIN tops USING (aoi_id) WHERE z <= top),
events_ AS (SELECT aoi_id, batch * 10 AS pos, 'unreachable' AS outcome, NULL AS zoom, arg_min(last_error, z) AS error FROM lev GROUP BY aoi_id, batch HAVING bool_and(NOT fatal AND failed = sampled)
  UNION ALL SELECT aoi_id, batch * 10 + 1 + (top - z) % 3, CASE WHEN fatal THEN 'fatal' ELSE 'ok' END, CASE WHEN NOT fatal THEN z END, fatal_error FROM lev WHERE fatal OR accepted),
firstev AS (SELECT aoi_id, arg_min(outcome, pos) AS outcome, min(pos) AS pos FROM events_ GROUP BY aoi_id),
chosen AS (SELECT tops.aoi_id, top, CASE WHEN top IS NULL THEN 'too_large' ELSE coalesce(firstev.outcome, 'none') END AS outcome, events_.zoom, events_.error FROM tops LEFT JOIN firstev USING (aoi_id) LEFT JOIN events_ ON events_.aoi_id = tops.aoi_id AND events_.pos = firstev.pos)
"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    levels, some = probed(spark, sf_dir)
    levels, tallies = keep(levels, "levels"), keep(zoom.tally(some, ["aoi_id"]), "tallies")
    return levels, tallies, zoom.outcomes(tallies, layout.budget_top(levels, ["aoi_id"], OPTIONS.max_tiles), ["aoi_id"], OPTIONS)


@query(f"WITH {SQL_PROBED}, {SQL_OUTCOME} SELECT aoi_id, CAST(top AS INTEGER) AS top, outcome, CAST(zoom AS INTEGER) AS zoom, error FROM chosen")
def zoom_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)[2]


@query(f"""WITH {SQL_PROBED}, {SQL_OUTCOME}
SELECT t.aoi_id, t.z, t.tiles, CAST(0 AS BIGINT) AS sampled, CAST(0 AS BIGINT) AS ok, CAST(0 AS BIGINT) AS upsampled, false AS accepted, 'exceeds tile budget (' || t.tiles || ' > 2000)' AS reason FROM tiled t JOIN chosen USING (aoi_id) WHERE top IS NULL OR t.z > top
UNION ALL SELECT lev.aoi_id, lev.z, t.tiles, sampled, ok, upsampled, accepted, CASE WHEN ok < 0.5 * sampled THEN 'coverage ' || CAST(round(ok * 100e0 / sampled) AS INTEGER) || '% < 50%' WHEN accepted THEN 'imagery available' ELSE 'upsampled: ' || upsampled || ' of ' || (upsampled + sharp) || ' judged samples lack native detail' END
FROM lev JOIN chosen USING (aoi_id) JOIN tiled t ON t.aoi_id = lev.aoi_id AND t.z = lev.z WHERE NOT fatal AND (zoom IS NULL OR lev.z >= zoom)""")
def zoom_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, tallies, chosen = decided(spark, sf_dir)
    return zoom.attempts(levels, tallies, chosen, ["aoi_id"], OPTIONS).select("aoi_id", "z", "tiles", "sampled", "ok", "upsampled", "accepted", "reason")


# Gap filling, on a table of tile outcomes.


def pyramid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(wanted tiles at zoom 10, statuses of all tiles that could lend to them)."""
    k = F.col("o_orderkey").cast("long")
    wanted = table(spark, sf_dir, "orders").select(F.lit(10).alias("z"), (k * 7919 % 1024).alias("x"), (k * 104729 % 1024).alias("y")).distinct()
    rows = gapfill.family(wanted).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    h = (F.col("x") * 31 + F.col("y") * 17 + F.col("z") * 7) % 11
    return wanted, rows.select("z", "x", "y", F.when(h < 3, "ok").when(h < 5, "placeholder").otherwise("missing").alias("status"), F.when(h == 10, "timed out").alias("error"))


SQL_PYRAMID = """
wanted AS (SELECT DISTINCT 10 AS z, o_orderkey * 7919 % 1024 AS x, o_orderkey * 104729 % 1024 AS y FROM orders),
fam AS (SELECT z, x, y, u, ((x >> u) * 31 + (y >> u) * 17 + (z - u) * 7) % 11 AS h FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS u FROM wanted)),
best AS (SELECT z, x, y, min(CASE WHEN h < 3 THEN u END) AS near, max(CASE WHEN u = 0 THEN h END) AS own FROM fam GROUP BY z, x, y),
res AS (SELECT z, x, y, CASE WHEN near = 0 THEN 'native' WHEN near > 0 THEN 'gapfill' WHEN own IN (3, 4) THEN 'placeholder' ELSE 'empty' END AS kind, CAST(CASE WHEN near > 0 THEN z - near END AS INTEGER) AS from_zoom FROM best)
"""


@query(f"WITH {SQL_PYRAMID} SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, kind, from_zoom FROM res")
def gap_fill_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.provenance(*pyramid(spark, sf_dir))


@query(f"WITH {SQL_PYRAMID} SELECT CAST(x // 256 AS BIGINT) AS part, count(*) FILTER (kind = 'native') AS native, count(*) FILTER (kind = 'gapfill') AS gap_filled, count(*) FILTER (kind = 'placeholder') AS placeholder, count(*) FILTER (kind = 'empty') AS empty, bool_and(kind <> 'empty') AS complete FROM res GROUP BY x // 256")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gapfill.provenance(*pyramid(spark, sf_dir)).withColumn("part", F.expr("x div 256"))
    return gapfill.stats(found, ["part"])


# Clipping.


def polygons(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey") -> tuple[DataFrame, DataFrame]:
    """(windows at zoom 16, positions of two polygons of each area: a triangle left open, and a box with a hole)."""
    k = F.col(key).cast("long")
    base = table(spark, sf_dir, name).select(k.alias("aoi_id"), (k * 13 % 300 - 150 + 0.0123).alias("lon0"), (k * 7 % 120 - 60 + 0.0077).alias("lat0"))
    shape = [(0, 0, 0, 0.0, 0.0), (0, 0, 1, 0.011, 0.001), (0, 0, 2, 0.003, 0.008), *[(1, r, n, x, y) for r, (a, b) in enumerate(((0.005, 0.012), (0.007, 0.009))) for n, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b), (a, a)))]]
    rows = base.withColumn("s", F.explode(F.array(*[F.struct(F.lit(p).alias("polygon"), F.lit(r).alias("ring"), F.lit(n).alias("nth"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for p, r, n, x, y in shape])))
    positions = rows.select("aoi_id", F.lit(16).alias("z"), "s.polygon", "s.ring", "s.nth", (F.col("lon0") + F.col("s.dx")).alias("lon"), (F.col("lat0") + F.col("s.dy")).alias("lat"))
    boxes = base.select("aoi_id", F.lit(16).alias("z"), F.col("lat0").alias("min_lat"), (F.col("lat0") + 0.012).alias("max_lat"), F.col("lon0").alias("min_lon"), (F.col("lon0") + 0.012).alias("max_lon"))
    return m.tiled(m.windowed(boxes, F.col("z"))), positions


SQL_EDGES = f"""
base AS (SELECT CAST(s_suppkey AS BIGINT) AS aoi_id, s_suppkey * 13 % 300 - 150 + 0.0123e0 AS lon0, s_suppkey * 7 % 120 - 60 + 0.0077e0 AS lat0, 16 AS z FROM supplier),
areas AS (SELECT aoi_id, lat0 AS min_lat, lat0 + 0.012e0 AS max_lat, lon0 AS min_lon, lon0 + 0.012e0 AS max_lon FROM base), {sql_windows('areas', (16,))},
seg(polygon, ax, ay, qx, qy) AS (VALUES (0, 0e0, 0e0, 0.011e0, 0.001e0), (0, 0.011e0, 0.001e0, 0.003e0, 0.008e0), (0, 0.003e0, 0.008e0, 0e0, 0e0),
  (1, 0.005e0, 0.005e0, 0.012e0, 0.005e0), (1, 0.012e0, 0.005e0, 0.012e0, 0.012e0), (1, 0.012e0, 0.012e0, 0.005e0, 0.012e0), (1, 0.005e0, 0.012e0, 0.005e0, 0.005e0),
  (1, 0.007e0, 0.007e0, 0.009e0, 0.007e0), (1, 0.009e0, 0.007e0, 0.009e0, 0.009e0), (1, 0.009e0, 0.009e0, 0.007e0, 0.009e0), (1, 0.007e0, 0.009e0, 0.007e0, 0.007e0)),
edges AS (SELECT aoi_id, polygon, {sql_px('lon0 + ax')} AS ex0, {sql_py('lat0 + ay')} AS ey0, {sql_px('lon0 + qx')} AS ex1, {sql_py('lat0 + qy')} AS ey1 FROM base, seg)
"""
SQL_SPANS = """
lines AS (SELECT aoi_id, x0, x1, unnest(generate_series(y0, y1 - 1)) AS y FROM wins),
cross_ AS (SELECT l.aoi_id, polygon, l.y, l.x0, l.x1, ex0 + (l.y + 0.5e0 - ey0) * (ex1 - ex0) / (ey1 - ey0) AS x FROM lines l JOIN edges e ON l.aoi_id = e.aoi_id AND (ey0 <= l.y + 0.5e0) <> (ey1 <= l.y + 0.5e0)),
pairs AS (SELECT *, row_number() OVER o AS n, lead(x) OVER o AS nx FROM cross_ WINDOW o AS (PARTITION BY aoi_id, polygon, y ORDER BY x)),
spans AS (SELECT aoi_id, polygon, y, greatest(CAST(ceil(x - 0.5e0) AS BIGINT), x0) AS from_x, least(CAST(ceil(nx - 0.5e0) AS BIGINT), x1) AS to_x FROM pairs WHERE n % 2 = 1 AND nx IS NOT NULL),
inside AS (SELECT * FROM spans WHERE from_x < to_x)
"""


@query(f"WITH {SQL_EDGES} SELECT aoi_id, CAST(polygon AS INTEGER) AS polygon, round(ex0, 3) AS ex0, round(ey0, 3) AS ey0, round(ex1, 3) AS ex1, round(ey1, 3) AS ey1 FROM edges")
def mask_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.edges(polygons(spark, sf_dir)[1], ["aoi_id"]).select("aoi_id", "polygon", *[F.round(c, 3).alias(c) for c in ("ex0", "ey0", "ex1", "ey1")])


def area_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, positions = polygons(spark, sf_dir)
    return found, clip.spans(clip.crossings(clip.edges(positions, ["aoi_id"]), found, ["aoi_id"]), ["aoi_id"])


@query(f"WITH {SQL_EDGES}, {SQL_SPANS} SELECT aoi_id, CAST(polygon AS INTEGER) AS polygon, y, from_x, to_x FROM inside")
def scanline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_spans(spark, sf_dir)[1]


@query(f"WITH {SQL_EDGES}, {SQL_SPANS}, px AS (SELECT DISTINCT aoi_id, y, unnest(generate_series(from_x, to_x - 1)) AS x FROM inside) SELECT aoi_id, count(*) AS pixels FROM px GROUP BY aoi_id")
def mask_union_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, positions = polygons(spark, sf_dir)
    # Areas are dealt out before their rows of pixels are made: these are then sorted where they are, a few areas to a task, and none move.
    dealt = positions.repartition(max(1, -(-found.count() // AREAS_A_TASK)), "aoi_id")
    return clip.pixels(clip.spans(clip.crossings(clip.edges(dealt, ["aoi_id"]), found.hint("merge"), ["aoi_id"]), ["aoi_id"]), ["aoi_id"])


@query(f"WITH {SQL_EDGES}, {SQL_SPANS} SELECT DISTINCT aoi_id, y // 256 AS y, unnest(generate_series(from_x // 256, (to_x - 1) // 256)) AS x FROM inside")
def clip_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = area_spans(spark, sf_dir)
    return clip.kept(layout.tiles(found).select("aoi_id", "y", "x"), spans, ["aoi_id"])


@query(f"WITH {SQL_EDGES}, {SQL_SPANS}, used AS (SELECT DISTINCT aoi_id, y // 256 AS y, unnest(generate_series(from_x // 256, (to_x - 1) // 256)) AS x FROM inside) SELECT t.aoi_id, any_value(tiles) - count(used.x) AS skipped FROM tiled t LEFT JOIN used ON t.aoi_id = used.aoi_id GROUP BY t.aoi_id")
def clip_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = area_spans(spark, sf_dir)
    gone = clip.skipped(layout.tiles(found).select("aoi_id", "y", "x"), spans, ["aoi_id"])
    return found.select("aoi_id").join(gone, "aoi_id", "left").groupBy("aoi_id").agg(F.count("x").alias("skipped"))


@query(f"""
WITH {SQL_EDGES}, pts AS (SELECT aoi_id, n, min_lon + (n % 5) * 0.0024e0 + 0.00011e0 AS lon, min_lat + (n // 5) * 0.0024e0 + 0.00013e0 AS lat, 16 AS z FROM areas, (SELECT unnest(generate_series(0, 24)) AS n)),
pix AS (SELECT *, floor({sql_px('lon')}) + 0.5e0 AS cx, floor({sql_py('lat')}) + 0.5e0 AS cy FROM pts),
hits AS (SELECT p.aoi_id, p.n, polygon, count(*) AS c FROM pix p JOIN edges e ON p.aoi_id = e.aoi_id AND (ey0 <= cy) <> (ey1 <= cy) AND ex0 + (cy - ey0) * (ex1 - ex0) / (ey1 - ey0) <= cx GROUP BY ALL)
SELECT p.aoi_id, CAST(p.n AS INTEGER) AS n, coalesce(bool_or(c % 2 = 1), false) AS inside FROM pix p LEFT JOIN hits h ON p.aoi_id = h.aoi_id AND p.n = h.n GROUP BY p.aoi_id, p.n
""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of 25 places of each area lie in its polygons, by an equal-key join with the spans of their pixel rows."""
    found, spans = area_spans(spark, sf_dir)
    grid = found.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(24))))
    lon, lat = F.col("min_lon") + (F.col("n") % 5) * 0.0024 + 0.00011, F.col("min_lat") + F.floor(F.col("n") / 5) * 0.0024 + 0.00013
    points = grid.select("aoi_id", "n", F.floor(m.lon_to_px(lon, F.col("z"))).alias("px"), F.floor(m.lat_to_py(lat, F.col("z"))).alias("y"))
    joined = points.join(spans, ["aoi_id", "y"], "left")
    return joined.groupBy("aoi_id", "n").agg(F.coalesce(F.bool_or((F.col("px") >= F.col("from_x")) & (F.col("px") < F.col("to_x"))), F.lit(False)).alias("inside"))


@query(f"""WITH {SQL_EDGES}, pts AS (SELECT aoi_id, unnest([lat0 + 0.001e0, lat0, lat0 + 0.008e0]) AS lat, unnest([lon0 + 0.011e0, lon0, lon0 + 0.003e0]) AS lon FROM base UNION ALL SELECT aoi_id, unnest([lat0 + 0.005e0, lat0 + 0.012e0]), unnest([lon0 + 0.005e0, lon0 + 0.012e0]) FROM base)
SELECT aoi_id, round(min(lat), 9) AS min_lat, round(min(lon), 9) AS min_lon, round(max(lat), 9) AS max_lat, round(max(lon), 9) AS max_lon FROM pts GROUP BY aoi_id""")
def polygon_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each area's polygons, holes included."""
    ends = {"min_lat": F.min("lat"), "min_lon": F.min("lon"), "max_lat": F.max("lat"), "max_lon": F.max("lon")}
    return polygons(spark, sf_dir)[1].groupBy("aoi_id").agg(*[F.round(f, 9).alias(n) for n, f in ends.items()])


# The synthetic world, pixels and tiles.

SQL_LATTICE = "((({h}) ^ (({h}) >> 15)) & 65535) / 65535e0"


def sql_lattice(x: str, y: str, k: str) -> str:
    h1 = f"xor(xor((({x}) * 73856093) & 4294967295, (({y}) * 19349663) & 4294967295), (({k}) * 83492791) & 4294967295)"
    h2 = f"((xor({h1}, ({h1}) >> 13) * 1540483477) & 4294967295)"
    return f"((xor({h2}, {h2} >> 15) & 65535) / 65535e0)"


@query(f"SELECT CAST(event_id AS BIGINT) AS id, round({sql_lattice('CAST(event_id * 7919 % 2000000 AS BIGINT)', 'CAST(event_id * 104729 % 3000000 AS BIGINT)', 'CAST(event_id % 8 AS BIGINT)')}, 12) AS value FROM events")
def noise_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("long")
    return table(spark, sf_dir, "events").select(k.alias("id"), F.round(synthetic.lattice(k * 7919 % 2000000, k * 104729 % 3000000, k % 8), 12).alias("value"))


def sql_noise(k: int) -> str:
    s = 1 << k
    x0, y0 = f"(gx // {s})", f"(gy // {s})"
    fx, fy = f"((gx - {x0} * {s} + 0.5e0) / {s})", f"((gy - {y0} * {s} + 0.5e0) / {s})"
    a, b, c, d = (f"l{k}{i}" for i in "abcd")
    return f"({a} * (1 - {fx}) + {b} * {fx}) * (1 - {fy}) + ({c} * (1 - {fx}) + {d} * {fx}) * {fy}"


SQL_WORLD = (
    "px AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id * 7919 % 2000003 AS BIGINT) AS gx, CAST(event_id * 104729 % 3000017 AS BIGINT) AS gy FROM events)"
    ", lat AS (SELECT *, " + ", ".join(f"{sql_lattice(f'gx // {1 << k} + {dx}', f'gy // {1 << k} + {dy}', str(k))} AS l{k}{i}" for k in range(8) for i, dx, dy in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1))) + " FROM px)"
    ", tot AS (SELECT id, 128e0 + ((" + ") + (".join(sql_noise(k) for k in range(8)) + ") - 4e0) * 28e0 AS g FROM lat)"
)


@query(f"WITH {SQL_WORLD} SELECT id, CAST(floor(greatest(0, least(255, g * 0.9e0))) AS INTEGER) AS r, CAST(floor(greatest(0, least(255, g))) AS INTEGER) AS g, CAST(floor(greatest(0, least(255, g * 0.75e0 + 20e0))) AS INTEGER) AS b FROM tot")
def world_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("long")
    return synthetic.ground(table(spark, sf_dir, "events").select(k.alias("id"), (k * 7919 % 2000003).alias("gx"), (k * 104729 % 3000017).alias("gy"))).drop("gx", "gy")


def block(key: int, width: int = 64, height: int = 64) -> np.ndarray:
    """An image for a key: nearly grey, with darker, coloured or bright pixels."""
    y, x = np.mgrid[:height, :width]
    h = (x * 7 + y * 13 + key * 29) % 100
    grey = np.minimum(np.where(h < key, 110, 140 + key * 5 + h % 3), 255)
    green = np.minimum(grey + (np.where(h < 50, 40, h % 5) if key % 4 == 3 else h % 5), 255)
    return np.dstack([grey, green, grey, np.full_like(grey, 255)]).astype(np.uint8)


def drawn(keys: DataFrame, image: Callable[[int], np.ndarray]) -> DataFrame:
    """id, width, height, data: an image for each key."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                made = image(key)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([made.shape[1]], pa.int32()), pa.array([made.shape[0]], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["id", "width", "height", "data"])

    return keys.select(F.col(keys.columns[0]).cast("long").alias("id")).mapInArrow(draw, "id long, width int, height int, data binary")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey")


def sampled_block(key: int) -> np.ndarray:
    """An image whose every fourth pixel either way is a block's; the others must not count."""
    out = np.full((256, 256, 4), (250, 10, 90, 255), np.uint8)
    out[::4, ::4] = block(key)
    return out


SQL_BLOCKS = """
pts AS (SELECT CAST(n_nationkey AS BIGINT) AS aoi_id, x, y, (x * 7 + y * 13 + n_nationkey * 29) % 100 AS h FROM nation, (SELECT unnest(generate_series(0, 63)) AS x), (SELECT unnest(generate_series(0, 63)) AS y)),
base AS (SELECT aoi_id, x, y, CAST(least(255, CASE WHEN h < aoi_id THEN 110 ELSE 140 + aoi_id * 5 + h % 3 END) AS INTEGER) AS r, CAST(CASE WHEN aoi_id % 4 = 3 AND h < 50 THEN 40 ELSE h % 5 END AS INTEGER) AS tint FROM pts),
blocks AS (SELECT aoi_id, x, y, r, least(255, r + tint) AS g, r AS b FROM base),
hist AS (SELECT aoi_id, (r + g + b) // 3 AS level, count(*) AS n FROM blocks WHERE greatest(r, g, b) - least(r, g, b) <= 8 GROUP BY ALL)
"""
SQL_FILLER = """
tot AS (SELECT aoi_id, count(*) AS samples FROM blocks GROUP BY aoi_id), top AS (SELECT aoi_id, sum(n) AS grey, arg_max(level, n * 1000 - level) AS mode FROM hist GROUP BY aoi_id),
near AS (SELECT h.aoi_id, sum(n) AS near FROM hist h JOIN top t ON h.aoi_id = t.aoi_id AND abs(level - mode) <= 8 GROUP BY h.aoi_id),
filler AS (SELECT tot.aoi_id, samples, CAST(coalesce(grey, 0) AS BIGINT) AS grey, CAST(mode AS INTEGER) AS mode, CAST(coalesce(near, 0) AS BIGINT) AS near, coalesce(grey >= 0.97 * samples AND mode BETWEEN 150 AND 235 AND near >= 0.75 * samples, false) AS placeholder FROM tot LEFT JOIN top USING (aoi_id) LEFT JOIN near USING (aoi_id))
"""


@query(f"WITH {SQL_BLOCKS} SELECT aoi_id, CAST(level AS INTEGER) AS level, n, CAST(row_number() OVER (PARTITION BY aoi_id ORDER BY n DESC, level) AS INTEGER) AS nth FROM hist")
def grey_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.facts(drawn(nations(spark, sf_dir), sampled_block), quality.ranked_levels, "level int, n long, nth int").withColumnRenamed("id", "aoi_id")


@query(f"WITH {SQL_BLOCKS}, {SQL_FILLER} SELECT * FROM filler")
def placeholder_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.facts(drawn(nations(spark, sf_dir), sampled_block), lambda rgb: [quality.filler_facts(rgb)], "samples long, grey long, mode int, near long, placeholder boolean").withColumnRenamed("id", "aoi_id")


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("nth"), (F.col("l_quantity") / 10).alias("top"), (F.col("l_discount") * 100).alias("next"), (F.col("l_tax") * 300).alias("variance"))


@query("""WITH t AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INTEGER) AS nth, l_quantity / 10 AS top, l_discount * 100 AS next, l_tax * 300 AS variance FROM lineitem)
SELECT k, nth, CASE WHEN variance < 4 THEN 'inconclusive' WHEN next < 2 AND variance >= 16 THEN 'upsampled' WHEN next < 2 THEN 'inconclusive' WHEN top / next < 0.2e0 THEN 'upsampled' ELSE 'native' END AS verdict FROM t""")
def sharpness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energies(spark, sf_dir).select("k", "nth", quality.verdict(F.col("top"), F.col("next"), F.col("variance")).alias("verdict"))


@query(f"WITH {SQL_BLOCKS} SELECT aoi_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, sum(g) / 4e0 AS g FROM blocks WHERE x < 62 GROUP BY aoi_id, x // 2, y // 2")
def half_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of the green of images of 63 columns: the odd one goes."""

    def rows(rgb: np.ndarray) -> list[tuple]:
        half = quality.halved(rgb[..., 1].astype(np.float64))
        return [(x, y, float(half[y, x])) for y, x in np.ndindex(*half.shape)]

    return quality.facts(drawn(nations(spark, sf_dir), lambda k: block(k, 63)), rows, "x int, y int, g double").withColumnRenamed("id", "aoi_id")


SQL_LUMA = "luma AS (SELECT aoi_id, x, y, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS v FROM blocks)"


@query(f"WITH {SQL_BLOCKS}, {SQL_LUMA} SELECT aoi_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM luma GROUP BY aoi_id")
def luminance_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(rgb: np.ndarray) -> list[tuple]:
        luma = quality.luminance(rgb)
        return [(float(luma.mean()), quality.variance_of(luma))]

    found = quality.facts(drawn(nations(spark, sf_dir), block), rows, "mean double, variance double")
    return found.select(F.col("id").alias("aoi_id"), F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


SCALE = 0.37


@query(f"""WITH {SQL_BLOCKS}, cells AS (SELECT i, CAST(floor(i / {SCALE}e0) AS BIGINT) AS a, least(greatest(CAST(floor((i + 1) / {SCALE}e0) AS BIGINT), CAST(floor(i / {SCALE}e0) AS BIGINT) + 1), 64) AS e FROM (SELECT unnest(generate_series(0, {int(64 * SCALE) - 1})) AS i)),
spread AS (SELECT i, unnest(generate_series(a, e - 1)) AS p FROM cells)
SELECT aoi_id, CAST(cx.i AS INTEGER) AS x, CAST(cy.i AS INTEGER) AS y, CAST(sum(r) // count(*) AS INTEGER) AS r, CAST(sum(g) // count(*) AS INTEGER) AS g, CAST(sum(b) // count(*) AS INTEGER) AS b FROM blocks JOIN spread cx ON cx.p = blocks.x JOIN spread cy ON cy.p = blocks.y GROUP BY aoi_id, cx.i, cy.i""")
def overview_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images give to an overview of 0.37 of their size."""

    def rows(rgb: np.ndarray) -> list[tuple]:
        side = int(64 * SCALE)
        means = render.block_means(np.dstack([rgb, rgb[..., :1]]), 0, 0, SCALE, side, side)[2]
        return [(x, y, *means[y, x, :3].tolist()) for y, x in np.ndindex(*means.shape[:2])]

    return quality.facts(drawn(nations(spark, sf_dir), block), rows, "x int, y int, r int, g int, b int").withColumnRenamed("id", "aoi_id")


def sql_lost(fine: str, coarse: str, side: int) -> str:
    """Mean squared distance of a picture from the bilinear one that its half gives, border left out."""
    place = lambda v: f"greatest(0, least(CAST(trunc(({v} + 0.5e0) / 2 - 0.5e0) AS BIGINT), {side // 2 - 2}))"
    corner = lambda name, dy, dx: f"JOIN {coarse} {name} ON {name}.aoi_id = p.aoi_id AND {name}.y = p.y0 + {dy} AND {name}.x = p.x0 + {dx}"
    return f"""(SELECT p.aoi_id, avg(power(p.v - ((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy), 2)) AS e
  FROM (SELECT *, (x + 0.5e0) / 2 - 0.5e0 - x0 AS fx, (y + 0.5e0) / 2 - 0.5e0 - y0 AS fy FROM (SELECT *, {place('x')} AS x0, {place('y')} AS y0 FROM {fine} WHERE x BETWEEN 1 AND {side - 2} AND y BETWEEN 1 AND {side - 2})) p
  {corner('a', 0, 0)} {corner('b', 0, 1)} {corner('c', 1, 0)} {corner('d', 1, 1)} GROUP BY p.aoi_id)"""


@query(f"""WITH {SQL_BLOCKS.replace("hist AS (SELECT aoi_id, (r + g + b) // 3 AS level, count(*) AS n FROM blocks WHERE", "hist AS (SELECT aoi_id, (r + g + b) // 3 AS level, count(*) AS n FROM blocks WHERE x % 4 = 0 AND y % 4 = 0 AND")}, {SQL_FILLER.replace("count(*) AS samples FROM blocks", "count(*) AS samples FROM blocks WHERE x % 4 = 0 AND y % 4 = 0")}, {SQL_LUMA},
half AS (SELECT aoi_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM luma GROUP BY aoi_id, x // 2, y // 2), quarter AS (SELECT aoi_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM half GROUP BY aoi_id, x // 2, y // 2),
energy AS (SELECT f.aoi_id, t.e AS top, n.e AS next, v.variance FROM filler f JOIN {sql_lost('luma', 'half', 64)} t ON t.aoi_id = f.aoi_id JOIN {sql_lost('half', 'quarter', 32)} n ON n.aoi_id = f.aoi_id JOIN (SELECT aoi_id, var_pop(v) AS variance FROM luma GROUP BY aoi_id) v ON v.aoi_id = f.aoi_id WHERE NOT placeholder)
SELECT f.aoi_id, CASE WHEN placeholder THEN 'placeholder' ELSE 'ok' END AS status, round(top, 6) AS top, round(next, 6) AS next, round(variance, 6) AS variance,
  CASE WHEN variance < 4 THEN 'inconclusive' WHEN next < 2 AND variance >= 16 THEN 'upsampled' WHEN next < 2 THEN 'inconclusive' WHEN top / next < 0.2e0 THEN 'upsampled' WHEN top IS NOT NULL THEN 'native' END AS verdict FROM filler f LEFT JOIN energy e ON e.aoi_id = f.aoi_id""")
def tile_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole judgements: filler or not, energies of two octaves, variance, verdict."""
    tiles = drawn(nations(spark, sf_dir), block).select(F.lit(9).alias("z"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), F.lit("ok").alias("status"), "width", "height", "data")
    return quality.judged(tiles).select(F.col("x").alias("aoi_id"), "status", *[F.round(c, 6).alias(c) for c in ("top", "next", "variance")], "verdict")


# Tiles by formula, for stretching and stitching.


def formula_tile(z: int, x: int, y: int) -> np.ndarray:
    py, px = np.mgrid[:256, :256]
    return np.dstack([(px * 3 + py * 5 + x * 7 + y * 11 + z) % 256, (px * py + x + y) % 256, (px * px + py + z * 5) % 256, np.full((256, 256), 255)]).astype(np.uint8)


def sql_formula(z: str, x: str, y: str, px: str, py: str) -> tuple[str, str, str]:
    return f"(({px}) * 3 + ({py}) * 5 + ({x}) * 7 + ({y}) * 11 + {z}) % 256", f"(({px}) * ({py}) + ({x}) + ({y})) % 256", f"(({px}) * ({px}) + ({py}) + {z} * 5) % 256"


def formula_tiles(wanted: DataFrame) -> DataFrame:
    """z, x, y, status, width, height, data of distinct tiles."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row = (r["z"], r["x"], r["y"], "ok", 256, 256, formula_tile(r["z"], r["x"], r["y"]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["z", "x", "y", "status", "width", "height", "data"])

    return wanted.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long")).distinct().mapInArrow(draw, synthetic.TILE_SCHEMA)


def sql_stretched() -> str:
    side = lambda nth, i: f"(({nth} % (1 << up)) * (256e0 / (1 << up)) + ({i} + 0.5e0) * ((256e0 / (1 << up)) / 256) - 0.5e0)"
    value = lambda k: " + ".join(f"({sql_formula('(10 - up)', '(x >> up)', '(y >> up)', px, py)[k]}) * {wx} * {wy}" for px, wx in (("lx", "(1 - fx)"), ("hx", "fx")) for py, wy in (("ly", "(1 - fy)"), ("hy", "fy")))
    return f"""want AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 37 % 1024 AS BIGINT) AS x, CAST(n_nationkey * 91 % 1024 AS BIGINT) AS y, CAST(n_nationkey % 5 AS INTEGER) AS up FROM nation),
at_ AS (SELECT *, {side('x', 'i')} AS sx, {side('y', 'j')} AS sy FROM want, (SELECT unnest(generate_series(0, 255, 17)) AS i), (SELECT unnest(generate_series(0, 255, 13)) AS j)),
low AS (SELECT *, CASE WHEN sx < 0 THEN 0 ELSE least(CAST(trunc(sx) AS BIGINT), 255) END AS lx, CASE WHEN sy < 0 THEN 0 ELSE least(CAST(trunc(sy) AS BIGINT), 255) END AS ly FROM at_),
part AS (SELECT *, CASE WHEN sx < 0 OR lx >= 255 THEN 0e0 ELSE sx - lx END AS fx, CASE WHEN sy < 0 OR ly >= 255 THEN 0e0 ELSE sy - ly END AS fy, least(lx + 1, 255) AS hx, least(ly + 1, 255) AS hy FROM low)
SELECT k, CASE WHEN up = 0 THEN 'native' ELSE 'gapfill' END AS kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {', '.join(f'CAST(floor({value(c)} + 0.5e0) AS INTEGER) AS {n}' for c, n in enumerate('rgb'))} FROM part"""


@query(f"WITH {sql_stretched()}")
def gap_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of tiles that are drawn from their ancestors up to four levels above."""
    k = F.col("n_nationkey").cast("long")
    wanted = keep(table(spark, sf_dir, "nation").select(k.alias("k"), F.lit(10).alias("z"), (k * 37 % 1024).alias("x"), (k * 91 % 1024).alias("y")), "wanted")
    lent = gapfill.family(wanted).where("up = k % 5").select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    tiles = keep(formula_tiles(lent), "tiles")
    # What another tile's ancestor lends must not count here: each tile is resolved against its own.
    statuses = gapfill.family(wanted).where("up = k % 5").select("k", F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    resolved = wanted.join(statuses.select("k", (F.lit(10) - F.col("z")).alias("up")), "k").select("k", F.lit(10).alias("z"), "x", "y", F.when(F.col("up") == 0, "native").otherwise("gapfill").alias("kind"), F.when(F.col("up") > 0, F.lit(10) - F.col("up")).cast("int").alias("from_zoom"))
    images_ = gapfill.pixels(resolved, tiles).select(F.col("k").alias("id"), F.lit(256).alias("width"), F.lit(256).alias("height"), F.col("image").alias("data"))
    found = quality.facts(images_, lambda rgb: [(i, j, *rgb[j, i].tolist()) for i in range(0, 256, 17) for j in range(0, 256, 13)], "i int, j int, r int, g int, b int")
    return found.join(resolved.select(F.col("k").alias("id"), "kind"), "id").select(F.col("id").alias("k"), "kind", "i", "j", "r", "g", "b")


def sql_stitched() -> str:
    r, g, b = sql_formula("16", "(x // 256)", "(y // 256)", "x % 256", "y % 256")
    return f"""spots AS (SELECT aoi_id, x, unnest(generate_series(CAST(ceil(y0 / 31e0) AS BIGINT) * 31, y1 - 1, 31)) AS y FROM (SELECT aoi_id, y0, y1, unnest(generate_series(CAST(ceil(x0 / 29e0) AS BIGINT) * 29, x1 - 1, 29)) AS x FROM wins)),
hit AS (SELECT s.aoi_id, s.x, s.y, count(i.y) > 0 AS seen FROM spots s LEFT JOIN inside i ON i.aoi_id = s.aoi_id AND i.y = s.y AND i.from_x <= s.x AND i.to_x > s.x GROUP BY ALL)
SELECT aoi_id, x, y, {', '.join(f'CAST(CASE WHEN seen THEN {v} ELSE 0 END AS INTEGER) AS {n}' for v, n in ((r, 'r'), (g, 'g'), (b, 'b'), ('255', 'a')))} FROM hit"""


@query(f"WITH {SQL_EDGES.replace('s_suppkey', 'n_nationkey').replace('FROM supplier', 'FROM nation')}, {SQL_SPANS}, {sql_stitched()}")
def stitch_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the encoded, clipped chunks of nations' areas, decoded again."""
    windows_, positions = polygons(spark, sf_dir, "nation", "n_nationkey")
    plan, spans = keep(layout.grid(windows_, 512), "plan"), keep(clip.spans(clip.crossings(clip.edges(positions, ["aoi_id"]), windows_, ["aoi_id"]), ["aoi_id"]), "spans")
    chunks = keep(layout.chunks(plan.drop("chunk_rows", "chunk_cols"), 512), "chunks")
    wanted = keep(clip.kept(layout.chunk_of(layout.tiles(plan.drop("chunk_rows", "chunk_cols")), 512).select("aoi_id", "z", "x", "y", "chunk_row", "chunk_col"), spans, ["aoi_id"]), "wanted")
    placed = layout.placed(wanted.join(chunks.select("aoi_id", "chunk_row", "chunk_col", "cx0", "cy0", "cx1", "cy1"), ["aoi_id", "chunk_row", "chunk_col"]))
    drawn_ = render.stitched(chunks, placed.join(formula_tiles(wanted).select("z", "x", "y", F.col("data").alias("image")), ["z", "x", "y"]), spans, 512)
    files = drawn_.join(chunks.select("aoi_id", "chunk_row", "chunk_col", "cx0", "cy0"), ["aoi_id", "chunk_row", "chunk_col"]).select("aoi_id", "cx0", "cy0", "data")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                image = images.from_png(r["data"])
                left, top = -r["cx0"] % 29, -r["cy0"] % 31
                some = image[top::31, left::29]
                y, x = np.mgrid[: some.shape[0], : some.shape[1]]
                columns = [np.full(x.size, r["aoi_id"]), r["cx0"] + left + 29 * x.ravel(), r["cy0"] + top + 31 * y.ravel()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.array(some[..., c].ravel().astype(np.int32)) for c in range(4))], names=["aoi_id", "x", "y", "r", "g", "b", "a"])

    return files.mapInArrow(pixels, "aoi_id long, x long, y long, r int, g int, b int, a int")
