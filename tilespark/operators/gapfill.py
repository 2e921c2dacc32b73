"""Filling gaps: each tile's nearest ancestor with imagery, as a join; and the pixels that it lends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions import mercator as m

FURTHEST = 4
TILE = m.TILE


def family(wanted: DataFrame, furthest: int = FURTHEST) -> DataFrame:
    """Each tile with itself (up 0) and its ancestors: up, az, ax, ay."""
    rows = wanted.withColumn("up", F.explode(F.sequence(F.lit(0), F.least(F.lit(furthest), F.col("z").cast("int")))))
    return rows.withColumns({"az": (F.col("z") - F.col("up")).cast("int"), "ax": m.parent(F.col("x"), F.col("up")), "ay": m.parent(F.col("y"), F.col("up"))})


def provenance(wanted: DataFrame, statuses: DataFrame, fill: bool = True) -> DataFrame:
    """The columns of ``wanted`` with kind (native, gapfill, placeholder, empty) and from_zoom.

    Ancestors join by equal keys, so the nearest one is a minimum, not a search. ``statuses`` has one
    row a tile: z, x, y, status, and error if its read failed.
    """
    good = statuses.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.when(F.col("error").isNull(), F.col("status")).alias("found"))
    joined = family(wanted, FURTHEST if fill else 0).join(good, ["az", "ax", "ay"], "left")
    keys = wanted.columns
    best = joined.groupBy(*keys).agg(F.min(F.when(F.col("found") == "ok", F.col("up"))).alias("nearest"), F.max(F.when(F.col("up") == 0, F.col("found"))).alias("own"))
    return best.select(
        *keys,
        F.when(F.col("nearest") == 0, "native").when(F.col("nearest") > 0, "gapfill").when(F.col("own") == "placeholder", "placeholder").otherwise("empty").alias("kind"),
        F.when(F.col("nearest") > 0, F.col("z") - F.col("nearest")).cast("int").alias("from_zoom"),
    )


def refused(wanted: DataFrame, statuses: DataFrame, keys: list[str], fill: bool = True) -> DataFrame:
    """keys, error: groups of wanted tiles of which one meets a refusal before it meets imagery, going from itself up; and what was said."""
    found = statuses.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), "status", "error", "fatal")
    steps = family(wanted, FURTHEST if fill else 0).join(found, ["az", "ax", "ay"])
    good = F.col("error").isNull() & (F.col("status") == "ok")
    met = steps.groupBy(*keys, "z", "x", "y").agg(F.min(F.when(good | F.col("fatal"), F.struct("up", "fatal", "error"))).alias("first"))
    return met.where("first.fatal").groupBy(*keys).agg(F.min_by("first.error", F.struct("y", "x")).alias("error"))


def stats(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """keys, native, gap_filled, placeholder, empty, complete."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return resolved.groupBy(*keys).agg(count("native").alias("native"), count("gapfill").alias("gap_filled"), count("placeholder").alias("placeholder"), count("empty").alias("empty"), F.bool_and(F.col("kind") != "empty").alias("complete"))


def stretched(image: np.ndarray, x: int, y: int, up: int) -> np.ndarray:
    """The part of an ancestor's image that covers a tile, resampled to a whole one, bilinear about pixel centres."""
    if image.shape[0] != image.shape[1]:
        raise ValueError("ancestor tiles must be square")
    side, n = image.shape[0], 1 << up
    cell = side / n

    def axis(nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = nth * cell + (np.arange(TILE) + 0.5) * (cell / TILE) - 0.5
        low = np.where(at < 0, 0, np.minimum(at.astype(np.int64), side - 1))
        part = np.where((at < 0) | (low >= side - 1), 0.0, at - low)
        return low, np.minimum(low + 1, side - 1), part

    (x0, x1, fx), (y0, y1, fy) = axis(x % n), axis(y % n)
    fx, fy = fx[None, :, None], fy[:, None, None]
    source = image.astype(np.float64)
    row = lambda r: source[r[:, None], x0] * (1 - fx) + source[r[:, None], x1] * fx
    return (row(y0) * (1 - fy) + row(y1) * fy + 0.5).astype(np.uint8)


def pixels(resolved: DataFrame, tiles: DataFrame) -> DataFrame:
    """The resolved tiles with ``image``, 256 x 256 RGBA, null where empty. Only tiles whose image is used are joined, images last."""
    up = F.when(F.col("kind") == "gapfill", F.col("z") - F.col("from_zoom")).otherwise(0).cast("int")
    wanted = resolved.withColumn("up", up).withColumns({"az": (F.col("z") - F.col("up")).cast("int"), "ax": m.parent(F.col("x"), F.col("up")), "ay": m.parent(F.col("y"), F.col("up"))})
    source = tiles.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("width").alias("aw"), F.col("height").alias("ah"), F.col("data").alias("adata"))
    joined = wanted.where("kind <> 'empty'").join(source, ["az", "ax", "ay"])
    columns = resolved.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["x", "y", "up", "aw", "ah", "adata"]).to_pylist():
                image = np.frombuffer(r["adata"], np.uint8).reshape(r["ah"], r["aw"], 4)
                if image.shape[:2] != (TILE, TILE) and not r["up"]:
                    raise ValueError(f"tiles must be {TILE} x {TILE}")
                out.append((stretched(image, r["x"], r["y"], r["up"]) if r["up"] else image).tobytes())
            yield batch.select(columns).append_column("image", pa.array(out, pa.binary()))

    schema = resolved.withColumn("image", F.lit(None).cast("binary")).schema
    return joined.select(*columns, "up", "aw", "ah", "adata").mapInArrow(draw, schema)
