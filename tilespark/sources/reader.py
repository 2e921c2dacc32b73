"""A data source for tiles by HTTP: ``spark.read.format("tiles").option("url", ...).load()``.

Options: ``url`` with {z}, {x} and {y}; ``z``, ``x0``, ``y0``, ``x1``, ``y1``, the range of tiles, ends
included; ``token``; ``workers``, the partitions at most, each with one request at a time. ``data`` has
the RGBA rows of a plain PNG, ``body`` the bytes of any other form.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilespark.functions import settings
from tilespark.sources import http


class Part(InputPartition):
    """Every ``step``-th tile of the range from ``first`` on, counted row by row."""

    def __init__(self, first: int, step: int) -> None:
        super().__init__((first, step))


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        said = settings.error_of(url=options.get("url", ""), workers=int(options.get("workers", 16)))
        if said or not options.get("url"):
            raise ValueError(said or "-url must contain {z}, {x} and {y}")
        self.url, self.token, self.workers = options["url"], options.get("token", ""), int(options.get("workers", 16))
        self.z, self.x0, self.y0, self.x1, self.y1 = (int(options[k]) for k in ("z", "x0", "y0", "x1", "y1"))
        self.width, self.count = self.x1 - self.x0 + 1, max(0, self.x1 - self.x0 + 1) * max(0, self.y1 - self.y0 + 1)

    def partitions(self) -> list[InputPartition]:
        parts = max(1, min(self.workers, -(-self.count // http.TILES_A_TASK)))
        return [Part(k, parts) for k in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, step = partition.value
        client = http.Client()
        for nth in range(first, self.count, step):
            x, y = self.x0 + nth % self.width, self.y0 + nth // self.width
            got = client.get(http.address(self.url, self.z, x, y, self.token))
            image = body = None
            if got.status == "ok":
                try:
                    image = http.decoded(got.body)
                    body = got.body if image is None else None
                except (ValueError, OSError, IndexError, zlib.error, struct.error) as e:
                    got.status, got.error = "missing", f"tile {self.z}/{x}/{y}: decode: {e}"
            height, width = image.shape[:2] if image is not None else (None, None)
            yield (self.z, x, y, got.status, got.error, got.fatal, width, height, image.tobytes() if image is not None else None, got.requests, got.size, body)


class TileDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return http.FETCHED + ", body binary"

    def reader(self, schema: object) -> DataSourceReader:
        return TileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileDataSource)
