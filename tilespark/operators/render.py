"""Rendering: tiles to chunk canvases, masks, encoded files, overviews. A chunk is one group, so its size bounds a task's memory."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import clip
from tilespark.plans import layout
from tilespark.sources import images

LONGEST_OVERVIEW = 4096
BAND_BYTES = 32 << 20
CHUNK_KEYS = ["aoi_id", "chunk_row", "chunk_col"]
DRAWN = "aoi_id long, chunk_row long, chunk_col long, width int, height int, sha256 string, bytes long, data binary, part binary, part_x int, part_y int, part_w int, part_h int"


def overview_size(width: int, height: int) -> tuple[float, int, int]:
    scale = min(1.0, LONGEST_OVERVIEW / max(width, height))
    return scale, max(1, int(width * scale)), max(1, int(height * scale))


def block_means(image: np.ndarray, ox: int, oy: int, scale: float, width: int, height: int) -> tuple[int, int, np.ndarray]:
    """What a chunk at (ox, oy) gives to the overview: where it starts, and integer means of the pixels behind each of its."""

    def axis(offset: int, side: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
        first, last = int(offset * scale), min(int((offset + side) * scale), most)
        at = np.arange(first, max(first, last))
        low = np.maximum((at / scale).astype(np.int64) - offset, 0)
        high = np.minimum(np.maximum(((at + 1) / scale).astype(np.int64) - offset, low + 1), side)
        return first, low, high

    (x, x0, x1), (y, y0, y1) = axis(ox, image.shape[1], width), axis(oy, image.shape[0], height)
    if not len(x0) or not len(y0):
        return x, y, np.zeros((len(y0), len(x0), 4), np.uint8)
    # The pixels behind neighbours adjoin, so their sums are sums of runs; in bands, as sums take eight bytes each.
    out, band = np.empty((len(y0), len(x0), 4), np.uint8), max(1, BAND_BYTES // max(32 * len(x0) * int((y1 - y0).max()), 1))
    for at in range(0, len(y0), band):
        low, high = y0[at : at + band], y1[at : at + band]
        rows = np.add.reduceat(image[low[0] : high[-1], x0[0] : x1[-1]], x0 - x0[0], axis=1, dtype=np.int64)
        count = ((high - low)[:, None] * (x1 - x0))[..., None]
        out[at : at + band] = np.add.reduceat(rows, low - low[0], axis=0) // count
    return x, y, out


def canvas(table: pa.Table, spans: list[np.ndarray] | None, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """A chunk's RGBA pixels; where no tile or no polygon is, all zero. Tiles are read where they lie."""
    out = np.zeros((height, width, 4), np.uint8)
    places = [table.column(c).to_pylist() for c in ("px0", "py0", "px1", "py1", "ox", "oy")]
    for image, px0, py0, px1, py1, ox, oy in zip(table.column("image"), *places, strict=True):
        if image.is_valid:
            tile = np.frombuffer(image.as_buffer(), np.uint8).reshape(layout.m.TILE, layout.m.TILE, 4)
            out[py0:py1, px0:px1] = tile[oy : oy + py1 - py0, ox : ox + px1 - px0]
    if spans is not None:
        inside = clip.mask(zip(*(v.tolist() for v in spans), strict=True), x0, y0, width, height)
        for at in range(0, height, 256):
            out[at : at + 256][~inside[at : at + 256]] = 0
    return out


def spans_by_chunk(chunks: DataFrame, spans: DataFrame, side: int) -> DataFrame:
    """The spans of each chunk, by division: every chunk of a span's row that it reaches."""
    per = max(side // layout.m.TILE, 1)
    areas = chunks.select("aoi_id", "tx0", "ty0", "chunk_rows", "chunk_cols").distinct()
    single, zero = F.col("chunk_rows") * F.col("chunk_cols") == 1, F.lit(0).cast("long")
    cell = lambda v, first: F.when(single, zero).otherwise(F.expr(f"({v} div {layout.m.TILE} - {first}) div {per}"))
    rows = spans.join(areas, "aoi_id").withColumn("chunk_row", cell("y", "ty0"))
    return rows.withColumn("chunk_col", F.explode(F.sequence(cell("from_x", "tx0"), cell("(to_x - 1)", "tx0")))).select(*CHUNK_KEYS, "y", "from_x", "to_x")


def stitched(chunks: DataFrame, tiles: DataFrame, spans: DataFrame | None = None, side: int = layout.DEFAULT_CHUNK) -> DataFrame:
    """One row a chunk: its PNG, SHA-256, size, and its part of the overview (null for areas of one chunk).

    ``chunks`` as planned, of up to ``side`` pixels; ``tiles`` placed on their chunks, with image; ``spans`` inside pixels by area.
    """
    head = ["cx0", "cy0", "cx1", "cy1", "x0", "y0", "x1", "y1", "chunk_rows", "chunk_cols"]
    rows = tiles.select(*CHUNK_KEYS, "px0", "py0", "px1", "py1", "ox", "oy", "image")
    joined = chunks.select(*CHUNK_KEYS, *head).join(rows, CHUNK_KEYS, "left")

    def draw(table: pa.Table, lines: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        first = table.select([*CHUNK_KEYS, *head]).slice(0, 1).to_pylist()[0]
        x, y, w, h = first["cx0"], first["cy0"], first["cx1"] - first["cx0"], first["cy1"] - first["cy0"]
        inside = None if lines is None else [lines.column(c).to_numpy() for c in ("y", "from_x", "to_x")]
        image = canvas(table, inside, x, y, w, h)
        file = images.png(image)
        part: tuple = (None, None, None, None, None)
        if first["chunk_rows"] * first["chunk_cols"] > 1:
            scale, width, height = overview_size(first["x1"] - first["x0"], first["y1"] - first["y0"])
            px, py, block = block_means(image, x - first["x0"], y - first["y0"], scale, width, height)
            part = (block.tobytes(), px, py, block.shape[1], block.shape[0])
        row = (first["aoi_id"], first["chunk_row"], first["chunk_col"], w, h, hashlib.sha256(file).hexdigest(), len(file), file, *part)
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in DRAWN.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    grouped = joined.groupBy(*CHUNK_KEYS)
    if spans is None:
        return grouped.applyInArrow(lambda table: draw(table), DRAWN)
    return grouped.cogroup(spans_by_chunk(chunks, spans, side).groupBy(*CHUNK_KEYS)).applyInArrow(lambda table, lines: draw(table, lines), DRAWN)


def overviews(drawn: DataFrame, areas: DataFrame) -> DataFrame:
    """aoi_id, width, height, sha256, bytes, data: the overview of each area of several chunks. At most 4096 pixels a side."""
    parts = drawn.where("part IS NOT NULL").select("aoi_id", "chunk_row", "chunk_col", "part", "part_x", "part_y", "part_w", "part_h").join(areas.select("aoi_id", "x0", "y0", "x1", "y1"), "aoi_id")

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["chunk_row"], r["chunk_col"]))
        _, width, height = overview_size(rows[0]["x1"] - rows[0]["x0"], rows[0]["y1"] - rows[0]["y0"])
        out = np.zeros((height, width, 4), np.uint8)
        for r in rows:
            out[r["part_y"] : r["part_y"] + r["part_h"], r["part_x"] : r["part_x"] + r["part_w"]] = np.frombuffer(r["part"], np.uint8).reshape(r["part_h"], r["part_w"], 4)
        file = images.png(out)
        return pa.table({"aoi_id": pa.array([rows[0]["aoi_id"]], pa.int64()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "sha256": [hashlib.sha256(file).hexdigest()], "bytes": pa.array([len(file)], pa.int64()), "data": pa.array([file], pa.binary())})

    return parts.groupBy("aoi_id").applyInArrow(merge, "aoi_id long, width int, height int, sha256 string, bytes long, data binary")
