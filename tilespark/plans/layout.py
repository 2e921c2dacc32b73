"""Planning without any tile read: zoom tables, samples, tile lists, chunk grids.

Every step is a projection or an explode of short arrays; nothing is shuffled but
where a per-area maximum is asked for. Counts are arithmetic, so a plan for a
continent costs as much as one for a garden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions import labels
from tilespark.functions import mercator as m

DEFAULT_CHUNK, DEFAULT_TILES = 8192, 20000
BATCH = 3


def at_zooms(areas: DataFrame, top: int, bottom: int) -> DataFrame:
    """Each area at each zoom, highest first, with window and tile range."""
    levels = areas.withColumn("z", F.explode(F.sequence(F.lit(top), F.lit(bottom), F.lit(-1))))
    return m.tiled(m.windowed(levels, F.col("z")))


def grid(windows: DataFrame, side: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds chunk_rows and chunk_cols. One chunk if the window fits the side as given; else cells of whole tiles."""
    per = max(side // m.TILE, 1)
    single = (F.col("x1") - F.col("x0") <= side) & (F.col("y1") - F.col("y0") <= side)

    def cells(low: str, high: str) -> Column:
        return F.when(single, F.lit(1).cast("long")).otherwise(F.expr(f"({high} - {low} + {per}) div {per}"))

    return windows.withColumns({"chunk_rows": cells("ty0", "ty1"), "chunk_cols": cells("tx0", "tx1")})


def chunks(windows: DataFrame, side: int = DEFAULT_CHUNK) -> DataFrame:
    """One row a chunk: chunk_row, chunk_col, its window cx0..cy1 and tile range ctx0..cty1, and its name's suffix."""
    per = max(side // m.TILE, 1)
    cells = grid(windows, side).withColumn("chunk_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk_rows") - 1))).withColumn("chunk_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk_cols") - 1)))
    single = F.col("chunk_rows") * F.col("chunk_cols") == 1
    ranges = cells.withColumns({
        "ctx0": F.when(single, F.col("tx0")).otherwise(F.col("tx0") + F.col("chunk_col") * per),
        "cty0": F.when(single, F.col("ty0")).otherwise(F.col("ty0") + F.col("chunk_row") * per),
        "ctx1": F.when(single, F.col("tx1")).otherwise(F.least(F.col("tx0") + (F.col("chunk_col") + 1) * per - 1, F.col("tx1"))),
        "cty1": F.when(single, F.col("ty1")).otherwise(F.least(F.col("ty0") + (F.col("chunk_row") + 1) * per - 1, F.col("ty1"))),
    })
    return ranges.withColumns({
        "cx0": F.greatest("x0", F.col("ctx0") * m.TILE),
        "cy0": F.greatest("y0", F.col("cty0") * m.TILE),
        "cx1": F.least("x1", (F.col("ctx1") + 1) * m.TILE),
        "cy1": F.least("y1", (F.col("cty1") + 1) * m.TILE),
        "suffix": labels.chunk_suffix(F.col("chunk_row"), F.col("chunk_col"), F.col("chunk_rows"), F.col("chunk_cols")),
    })


def tiles(ranges: DataFrame) -> DataFrame:
    """One row a tile, x and y, rows of the range first to last. Only for ranges within a budget."""
    rows = ranges.withColumn("y", F.explode(F.sequence("ty0", "ty1")))
    return rows.withColumn("x", F.explode(F.sequence("tx0", "tx1")))


def chunk_of(tiles_: DataFrame, side: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds the chunk that a tile belongs to, by arithmetic on its place in the grid."""
    per = max(side // m.TILE, 1)
    single = F.col("chunk_rows") * F.col("chunk_cols") == 1
    zero = F.lit(0).cast("long")
    return grid(tiles_, side).withColumns({"chunk_row": F.when(single, zero).otherwise(F.expr(f"(y - ty0) div {per}")), "chunk_col": F.when(single, zero).otherwise(F.expr(f"(x - tx0) div {per}"))})


def placed(tiles_: DataFrame) -> DataFrame:
    """Adds where a tile falls on its chunk's canvas (px0..py1, cut to it) and how far into the tile that starts (ox, oy)."""
    left, top = F.col("x") * m.TILE - F.col("cx0"), F.col("y") * m.TILE - F.col("cy0")
    zero = F.lit(0).cast("long")
    return tiles_.withColumns({
        "px0": F.greatest(left, zero), "py0": F.greatest(top, zero),
        "px1": F.least(left + m.TILE, F.col("cx1") - F.col("cx0")), "py1": F.least(top + m.TILE, F.col("cy1") - F.col("cy0")),
        "ox": F.greatest(-left, zero), "oy": F.greatest(-top, zero),
    })


def samples(ranges: DataFrame) -> DataFrame:
    """At most nine tiles of each range, its corners, edge middles and centre, once each; ``nth`` is their order."""

    def three(low: str, high: str) -> Column:
        return F.array_distinct(F.array(F.col(low), F.expr(f"({low} + {high}) div 2"), F.col(high)))

    rows = ranges.select("*", F.posexplode(three("ty0", "ty1")).alias("row_", "y"))
    cells = rows.select("*", F.posexplode(three("tx0", "tx1")).alias("col_", "x"))
    return cells.withColumn("nth", F.col("row_") * 3 + F.col("col_")).drop("row_", "col_")


def budget_top(levels: DataFrame, keys: list[str], most: int = DEFAULT_TILES) -> DataFrame:
    """keys, top: the highest zoom whose tiles fit the budget; null if none does. Lower zooms are not held to it again."""
    return levels.groupBy(*keys).agg(F.max(F.when(F.col("tiles") <= most, F.col("z"))).alias("top"))


def batch_number(top: Column, z: Column, size: int = BATCH) -> Column:
    return F.floor((top - z) / size).cast("int")


def dry_run(areas: DataFrame, keys: list[str], top: int = 23, bottom: int = 1, side: int = DEFAULT_CHUNK, most: int = DEFAULT_TILES) -> DataFrame:
    """keys, z, meters_a_pixel, tiles, width, height, images, note: down to the first zoom that needs one tile."""
    levels = grid(at_zooms(areas, top, bottom), side)
    last = F.max(F.when(F.col("tiles") <= 1, F.col("z"))).over(Window.partitionBy(*keys))
    shown = levels.withColumn("last_", F.coalesce(last, F.lit(bottom))).where("z >= last_")
    return shown.select(
        *keys, "z", m.ground_resolution(m.center_lat(), F.col("z")).alias("meters_a_pixel"), "tiles", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
        (F.col("chunk_rows") * F.col("chunk_cols")).alias("images"), F.when(F.col("tiles") > most, "over budget").otherwise("").alias("note"),
    )
