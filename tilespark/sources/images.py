"""Images: PNG both ways, JPEG by the JVM, folders of stored tiles, and files with what GIS tools need beside them."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import mercator as m

SIGNATURE = b"\x89PNG\r\n\x1a\n"
BAND_BYTES = 8 << 20
#: Fixed value: the projection's well-known text, as GIS tools expect it.
PROJECTION = 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",0.0],PARAMETER["Standard_Parallel_1",0.0],PARAMETER["Auxiliary_Sphere_Type",0.0],UNIT["Meter",1.0]]'


class Unsupported(ValueError):
    """A form of PNG that is read by Spark's image reader only."""


def png(image: np.ndarray, level: int = 1) -> bytes:
    """An RGBA array as a PNG file."""
    height, width = image.shape[:2]

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    # In bands, so that no second copy of a large canvas is made.
    packer, packed, band = zlib.compressobj(level), [], max(1, BAND_BYTES // (4 * width + 1))
    for at in range(0, height, band):
        rows = image[at : at + band]
        lines = np.zeros((len(rows), 1 + 4 * width), np.uint8)
        lines[:, 1:] = rows.reshape(len(rows), -1)
        packed.append(packer.compress(lines.tobytes()))
    packed.append(packer.flush())
    return b"".join([SIGNATURE, part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), part(b"IDAT", b"".join(packed)), part(b"IEND", b"")])


def from_png(data: bytes) -> np.ndarray:
    """An RGBA array from a PNG of eight bits a channel: grey, RGB or RGBA, not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", b""
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", head)
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or step is None or laced:
        raise Unsupported("unsupported PNG")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.uint8)
    for y in range(height):
        rule, line = lines[y, 0], lines[y, 1:].reshape(width, step)
        up, row = out[y, 1:], out[y + 1]
        if rule == 0:
            row[1:] = line
        elif rule == 2:
            row[1:] = line + up
        elif rule == 1:
            row[1:] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        else:
            for x in range(width):
                a, b, c = row[x].astype(int), up[x].astype(int), out[y, x].astype(int)
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                row[x + 1] = (line[x] + guess).astype(np.uint8)
    flat = out[1:, 1:]
    solid = np.full((height, width, 1), 255, np.uint8)
    if step == 1:
        return np.concatenate([flat.repeat(3, axis=2), solid], axis=2)
    if step == 2:
        return np.concatenate([flat[..., :1].repeat(3, axis=2), flat[..., 1:]], axis=2)
    return np.concatenate([flat, solid], axis=2) if step == 3 else flat.copy()


def encoded(spark: SparkSession, image: np.ndarray, kind: str, quality: int = 90) -> bytes:
    """A PNG here, a JPEG by the driver's JVM. WebP needs an encoder that this environment lacks."""
    if kind == "png":
        return png(image)
    if kind != "jpeg":
        raise ValueError("webp output needs an encoder that is not installed; use .png or .jpg")
    jvm = spark.sparkContext._jvm
    io = jvm.javax.imageio.ImageIO
    source = io.read(jvm.java.io.ByteArrayInputStream(png(image)))
    flat = jvm.java.awt.image.BufferedImage(source.getWidth(), source.getHeight(), 1)
    flat.getGraphics().drawImage(source, 0, 0, None)
    writer = io.getImageWritersByFormatName("jpeg").next()
    wish = writer.getDefaultWriteParam()
    wish.setCompressionMode(2)
    wish.setCompressionQuality(float(quality) / 100)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(io.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(flat, None, None), wish)
    writer.dispose()
    return bytes(out.toByteArray())


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """z, x, y, status, width, height, data from files .../z/x/y.png or .jpg, decoded by Spark's image reader."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")
    place = [F.regexp_extract("origin", r"/(\d+)/(\d+)/(\d+)\.\w+$", k).alias(n) for k, n in ((1, "z"), (2, "x"), (3, "y"))]
    rows = found.select(*place, "width", "height", "nChannels", "data").where("z <> ''")

    def rgba(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                color = raw.repeat(3, axis=2) if r["nChannels"] == 1 else raw[..., [2, 1, 0]]
                alpha = raw[..., 3:] if r["nChannels"] == 4 else np.full((*raw.shape[:2], 1), 255, np.uint8)
                data = np.concatenate([color, alpha], axis=2).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(r["z"])], pa.int32()), pa.array([int(r["x"])], pa.int64()), pa.array([int(r["y"])], pa.int64()), pa.array(["ok"]), pa.array([r["width"]], pa.int32()), pa.array([r["height"]], pa.int32()), pa.array([data], pa.binary())], names=["z", "x", "y", "status", "width", "height", "data"])

    return rows.mapInArrow(rgba, "z int, x long, y long, status string, width int, height int, data binary")


def with_missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The wanted tiles as a source gives them: those that it doesn't have are missing."""
    joined = wanted.select("z", "x", "y").distinct().join(found, ["z", "x", "y"], "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("missing")))


def world_file(x0: Column, y0: Column, z: Column) -> Column:
    """Six lines: pixel size, no rotation, and the metres of the first pixel's centre."""
    size = m.mercator_resolution(z)
    return F.format_string("%.10f\n0.0\n0.0\n%.10f\n%.6f\n%.6f\n", size, -size, m.px_to_mercator_x(x0 + F.lit(0.5).cast("double"), z), m.py_to_mercator_y(y0 + F.lit(0.5).cast("double"), z))


def write_atomic(path: str, data: bytes) -> tuple[str, int]:
    """Writes beside ``path`` and renames, so readers see all or nothing; gives the SHA-256 and the size."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=os.path.splitext(path)[1])
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return hashlib.sha256(data).hexdigest(), len(data)
