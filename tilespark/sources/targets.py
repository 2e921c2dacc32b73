"""Targets: text to areas. Numbers become points or boxes, other text names a GeoJSON file, ``-`` means given text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import mercator as m

DEFAULT_RADIUS = 200.0
#: What counts as white space at the ends of a target.
WHITE = " \t\n\x0b\x0c\r\x85\xa0"
#: Numbers as they are written: no suffixes for types, which a cast would take.
NUMBER = r"^(?:[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?)|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)|(?i:nan))$"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def numbers(text: Column) -> Column:
    """The numbers of a list parted by commas, semicolons or spaces; null unless all fields are numbers and there is one."""
    fields = F.filter(F.split(trimmed(text), "[,; ]+"), lambda s: s != "")
    parsed = F.transform(fields, lambda s: F.when(s.rlike(NUMBER), s.try_cast("double")))
    return F.when((F.size(parsed) > 0) & ~F.exists(parsed, lambda v: v.isNull()), parsed)


# The sentences below are fixed values: rows are compared by them.


def place_error(lat: Column, lon: Column) -> Column:
    """What is wrong with a place; null if nothing. Not-a-number passes here and fails as an area."""
    lat_bad = ~F.isnan(lat) & ((lat < -90) | (lat > 90))
    lon_bad = ~F.isnan(lon) & ((lon < -180) | (lon > 180))
    return F.when(lat_bad, "latitude out of range; coordinates are lat,lon").when(lon_bad, "longitude out of range [-180, 180]")


def area_error(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """The first rule that an area breaks; null if none."""
    every = [min_lat, min_lon, max_lat, max_lon]
    odd = F.lit(False)
    for v in every:
        odd = odd | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(odd, "coordinates must be finite numbers")
        .when((min_lat < -90) | (max_lat > 90), "latitude out of range [-90, 90]")
        .when((min_lon < -180) | (max_lon > 180), "longitude out of range [-180, 180]")
        .when((min_lat >= max_lat) | (min_lon >= max_lon), "bounding box has zero area (check coordinate order: lat,lon)")
        .when((min_lat <= -m.MAX_LAT) | (max_lat >= m.MAX_LAT), "latitude beyond Web Mercator limit")
    )


def error_of_area() -> Column:
    return area_error(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon"))


def parsed(targets: DataFrame, radius: Column | None = None, text: str = "input") -> DataFrame:
    """Adds kind, the area's four columns and error to rows of text. ``kind`` is file or given for GeoJSON, whose area is null here."""
    radius = F.lit(DEFAULT_RADIUS) if radius is None else radius
    rows = targets.withColumns({"nums_": numbers(F.col(text)), "trim_": trimmed(F.col(text)), "radius_": radius.cast("double")})
    n = F.size("nums_")
    at = lambda i: F.get("nums_", i - 1)
    kind = F.when(F.coalesce("trim_", F.lit("")) == "", F.lit(None)).when(F.col("trim_") == "-", "given").when(F.col("nums_").isNull(), "file").when(n == 2, "point").when(n == 4, "bbox")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("first_error_", F.when(F.col("kind") == "point", place_error(at(F.lit(1)), at(F.lit(2)))).when(F.col("kind") == "bbox", F.coalesce(place_error(at(F.lit(1)), at(F.lit(2))), place_error(at(F.lit(3)), at(F.lit(4))))))
    first_error = (
        F.when(F.coalesce("trim_", F.lit("")) == "", "no target given")
        .when(F.col("kind").isNull(), F.concat(F.lit("expected 2 numbers (lat,lon) or 4 numbers (lat1,lon1,lat2,lon2), got "), n.cast("string")))
        .when(F.col("first_error_").isNotNull(), F.col("first_error_"))
        .when((F.col("kind") == "point") & (F.col("radius_") <= 0), "radius must be > 0 for a point target")
    )
    good = first_error.isNull() & F.col("kind").isin("point", "bbox")
    second = lambda i: F.coalesce(at(F.lit(i + 2)), at(F.lit(i)))
    boxes = rows.withColumns({"error": first_error, "good_": good}).withColumns({
        "min_lat": F.when(F.col("good_"), F.least(at(F.lit(1)), second(1))), "max_lat": F.when(F.col("good_"), F.greatest(at(F.lit(1)), second(1))),
        "min_lon": F.when(F.col("good_"), F.least(at(F.lit(2)), second(2))), "max_lon": F.when(F.col("good_"), F.greatest(at(F.lit(2)), second(2))),
    })
    names = ("min_lat", "min_lon", "max_lat", "max_lon")
    points = F.col("kind") == "point"
    joined = boxes.withColumns({f"{c}_b": F.col(c) for c in names})
    joined = m.padded(joined, F.col("radius_")).withColumns({c: F.when(points & F.col("good_"), F.col(c)).otherwise(F.col(f"{c}_b")) for c in names}).drop(*[f"{c}_b" for c in names])
    return joined.withColumn("error", F.coalesce("error", F.when(F.col("good_"), error_of_area()))).drop("nums_", "trim_", "radius_", "first_error_", "good_")
