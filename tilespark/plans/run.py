"""The whole run: choose zooms, lay out chunks, read tiles, fill gaps, clip, draw, describe.

One row is one area of interest; any number of areas run together. Each step is a
table in the shared folder, so a lost executor repeats one step.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions import labels, settings
from tilespark.functions import mercator as m
from tilespark.operators import clip, gapfill, quality, render, zoom
from tilespark.plans import layout
from tilespark.plans.store import keep
from tilespark.sources import images

KEYS = ["aoi_id"]
#: A source of tiles: distinct (z, x, y) to z, x, y, status, width, height, data, and, if it has them, error, fatal, requests, bytes.
Source = Callable[[DataFrame], DataFrame]


class NoImagery(RuntimeError):
    """An area for which no zoom was accepted."""


@dataclass(frozen=True)
class RunOptions:
    zoom: zoom.ZoomOptions = field(default_factory=zoom.ZoomOptions)
    chunk: int = layout.DEFAULT_CHUNK
    format: str = "png"
    quality: int = 90
    clip: bool = False
    world_file: bool = False
    gap_fill: bool = True
    provider: str = "tile source"
    template: str = ""
    attribution: str = ""
    workers: int = 16

    def __post_init__(self) -> None:
        settings.check(quality=self.quality, workers=self.workers, chunk=self.chunk, format=self.format)
        if self.format not in labels.LONGEST_SIDE:
            raise ValueError(f"unsupported format {self.format}")


@dataclass
class Run:
    """What a run made: tables by name. ``files`` and ``overviews`` hold encoded PNGs."""

    outcomes: DataFrame
    attempts: DataFrame
    areas: DataFrame
    chunks: DataFrame
    resolved: DataFrame
    stats: DataFrame
    files: DataFrame
    overviews: DataFrame
    network: DataFrame


class Reader:
    """What a run has read: each tile once, with the verdict on it. Only tiles that nobody has asked for yet go to the source."""

    def __init__(self, source: Source, detail_ratio: float, say: Callable[[str], None] = lambda text: None) -> None:
        self.source, self.detail_ratio, self.say = source, detail_ratio, say
        self.reads: list[DataFrame] = []
        self.judgements: list[DataFrame] = []

    def read(self, wanted: DataFrame, name: str, probing: bool = False) -> None:
        fresh = wanted.select("z", "x", "y").distinct()
        if self.judgements:
            fresh = fresh.join(self.statuses().select("z", "x", "y"), ["z", "x", "y"], "left_anti")
        fresh = keep(fresh, f"{name}-wanted")
        count = fresh.count()
        if self.judgements and not count:
            return
        self.say(f"{name}: {count} tiles")
        found = (self.source if probing else getattr(self.source, "strict", self.source))(fresh)
        for column, kind in (("error", "string"), ("fatal", "boolean"), ("requests", "int"), ("bytes", "long")):
            if column not in found.columns:
                found = found.withColumn(column, F.lit(None).cast(kind))
        self.reads.append(keep(found, name))
        self.judgements.append(keep(quality.judged(self.reads[-1], probing and self.detail_ratio > 0, self.detail_ratio), f"{name}-judged"))

    def statuses(self) -> DataFrame:
        """z, x, y, status, error, fatal, verdict: one row a tile, as reads are disjoint."""
        return together(self.judgements, ("z", "x", "y", "status", "error", "fatal", "verdict"))

    def tiles(self) -> DataFrame:
        return together(self.reads, ("z", "x", "y", "width", "height", "data"))

    def network(self) -> DataFrame:
        return together(self.reads, ("requests", "bytes")).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    def resolve(self, wanted: DataFrame, fill: bool) -> None:
        """Reads wanted tiles, then, level by level, the ancestors of those that have no imagery yet. A refusal ends a tile's way up."""
        self.read(wanted, "tiles")
        for up in range(1, gapfill.FURTHEST + 1 if fill else 1):
            met = self.statuses().where("error IS NULL AND status = 'ok' OR fatal").select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
            below = gapfill.family(wanted.select("z", "x", "y").distinct(), up - 1)
            done = below.join(met, ["az", "ax", "ay"], "left_semi").select("z", "x", "y").distinct()
            left = keep(wanted.select("z", "x", "y").distinct().where(F.col("z") >= up).join(done, ["z", "x", "y"], "left_anti"), f"gaps-{up}")
            if not left.limit(1).count():
                break
            self.read(gapfill.family(left, up).where(F.col("up") == up).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")), f"ancestors-{up}")


def together(parts: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.union(part.select(*columns))
    return out


def execute(areas: DataFrame, source: Source, options: RunOptions, positions: DataFrame | None = None, say: Callable[[str], None] = lambda text: None) -> Run:
    """Runs areas (aoi_id, min_lat, min_lon, max_lat, max_lon). ``positions`` are polygons (aoi_id, polygon, ring, nth, lon, lat) for clipping.

    A refusal decides only areas that meet it: at a level that is judged before one is accepted, or on the way
    from a wanted tile up to its nearest imagery. Their outcome is ``fatal``, with what was said; others go on.
    ``say`` is told what is about to be read, step by step.
    """
    if options.clip and positions is None:
        raise ValueError("clip needs polygons")
    reader = Reader(source, options.zoom.detail_ratio, say)

    def probe(wanted: DataFrame) -> DataFrame:
        reader.read(wanted, "probe", probing=True)
        return reader.statuses()

    outcomes, tallies = zoom.search(areas, KEYS, probe, options.zoom, keep)
    levels = layout.at_zooms(areas, options.zoom.max_zoom, options.zoom.min_zoom)
    tries = keep(zoom.attempts(levels, tallies, outcomes, KEYS, options.zoom), "attempts")
    chosen = areas.join(outcomes.where("outcome = 'ok'").select(*KEYS, F.col("zoom").alias("z")), KEYS)
    plan = keep(layout.grid(m.tiled(m.windowed(chosen, F.col("z"))), options.chunk), "areas")
    wanted = layout.chunk_of(layout.tiles(plan.drop("chunk_rows", "chunk_cols")), options.chunk).select("aoi_id", "z", "x", "y", "chunk_row", "chunk_col")
    spans = None
    skipped = wanted.groupBy(*KEYS).agg(F.lit(0).cast("long").alias("skipped"))
    if options.clip:
        edges = clip.edges(positions.where("polygon IS NOT NULL").join(plan.select("aoi_id", "z"), KEYS), KEYS)
        spans = keep(clip.spans(clip.crossings(edges, plan, KEYS), KEYS), "spans")
        every = wanted
        skipped = clip.skipped(every, spans, KEYS).groupBy(*KEYS).agg(F.count("*").alias("skipped"))
        wanted = clip.kept(every, spans, KEYS)
    wanted = keep(wanted, "wanted")
    reader.resolve(wanted, options.gap_fill)
    statuses = reader.statuses()
    bad = keep(gapfill.refused(wanted, statuses, KEYS, options.gap_fill), "refused")
    if bad.limit(1).count():
        said = bad.select(*KEYS, F.col("error").alias("said"))
        outcomes = keep(outcomes.join(said, KEYS, "left").select(*KEYS, "top", F.when(F.col("said").isNotNull(), "fatal").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("said").isNull(), F.col("zoom")).alias("zoom"), F.coalesce("said", "error").alias("error")), "outcomes")
        plan, wanted = (keep(df.join(bad.select(*KEYS), KEYS, "left_anti"), "able") for df in (plan, wanted))
    chunks = keep(layout.chunks(plan.drop("chunk_rows", "chunk_cols"), options.chunk), "chunks")

    resolved = keep(gapfill.provenance(wanted, statuses, options.gap_fill), "resolved")
    drawn = gapfill.pixels(resolved, reader.tiles())
    placed = layout.placed(drawn.join(chunks.select("aoi_id", "chunk_row", "chunk_col", "cx0", "cy0", "cx1", "cy1"), ["aoi_id", "chunk_row", "chunk_col"]))
    files = keep(render.stitched(chunks, placed, spans, options.chunk), "files")
    overviews = keep(render.overviews(files, plan), "overviews")
    stats = keep(plan.select(*KEYS).join(gapfill.stats(resolved, KEYS), KEYS, "left").join(skipped, KEYS, "left").na.fill(0).na.fill(True), "stats")
    return Run(outcomes, tries, plan, chunks, resolved, stats, files, overviews, reader.network())


def metadata(run: Run, aoi_id: int, target: dict, options: RunOptions, files: list[dict], overview: dict | None, elapsed: float, version: str) -> dict:
    """The record of one area, as the JSON sidecar has it; parts that are absent are left out."""
    row = run.areas.where(F.col("aoi_id") == aoi_id)
    z = F.col("z")
    facts = m.bounded(row, z).select(
        "*", F.round(m.ground_resolution(m.center_lat(), z), 4).alias("ground"), F.round(m.mercator_resolution(z), 6).alias("resolution"),
        *[F.round(f(F.col(c), z), 3).alias(n) for f, c, n in ((m.px_to_mercator_x, "x0", "mx0"), (m.py_to_mercator_y, "y1", "my0"), (m.px_to_mercator_x, "x1", "mx1"), (m.py_to_mercator_y, "y0", "my1"))],
    ).first()
    stats = run.stats.where(F.col("aoi_id") == aoi_id).first()
    tries = [t.asDict() for t in run.attempts.where(F.col("aoi_id") == aoi_id).orderBy(F.desc("z")).collect()]
    counts = ("sampled", "ok", "missing", "placeholder", "failed", "sharp", "upsampled")
    gaps = run.resolved.where((F.col("aoi_id") == aoi_id) & (F.col("kind") != "native")).orderBy("z", "y", "x").collect()
    network = run.network.first()
    out = {
        "tool": "tilespark", "version": version, "created_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "source": {"provider": options.provider, "url_template": options.template, "attribution": options.attribution},
        "target": {k: v for k, v in target.items() if not (k == "polygons" and not v)} | {"clip": options.clip},
        "zoom": {"selected": facts["z"], "max_requested": options.zoom.max_zoom, "min_allowed": options.zoom.min_zoom, "attempts": [{"zoom": t["z"], "tiles": t["tiles"], **{c: t[c] for c in counts if t[c]}, "accepted": t["accepted"], "reason": t["reason"]} for t in tries]},
        "resolution": {"ground_m_per_px": facts["ground"], "epsg3857_m_per_px": facts["resolution"]},
        "grid": {"tile_range": {"z": facts["z"], "x_min": facts["tx0"], "y_min": facts["ty0"], "x_max": facts["tx1"], "y_max": facts["ty1"]}, "tile_count": facts["tiles"], "pixel_width": facts["x1"] - facts["x0"], "pixel_height": facts["y1"] - facts["y0"], "chunk_rows": facts["chunk_rows"], "chunk_cols": facts["chunk_cols"], "chunk_max_side": options.chunk},
        "bounds": {"wgs84": {"min_lat": facts["south"], "min_lon": facts["west"], "max_lat": facts["north"], "max_lon": facts["east"]}, "epsg3857": [facts["mx0"], facts["my0"], facts["mx1"], facts["my1"]]},
        "output": {"format": options.format, "quality": options.quality, "files": files} | ({"overview": overview} if overview else {}),
        "tiles": {"native": stats["native"], "gap_filled": stats["gap_filled"], "placeholder": stats["placeholder"], "empty": stats["empty"], "skipped_outside_clip": stats["skipped"]},
    }
    if gaps:
        out["gap_tiles"] = [{"tile": {"z": g["z"], "x": g["x"], "y": g["y"]}, "source": {"kind": g["kind"]} | ({"from_zoom": g["from_zoom"]} if g["from_zoom"] is not None else {})} for g in gaps]
    return out | {"network": {"requests": network["requests"], "bytes": network["bytes"], "workers": options.workers}, "elapsed_seconds": round(elapsed, 3), "complete": stats["empty"] == 0}


def write(run: Run, aoi_id: int, path: str, target: dict, options: RunOptions, elapsed: float = 0.0, version: str = "1") -> dict:
    """Writes an area's images, world files, overview and JSON beside ``path``, chunk by chunk, each whole or not at all; gives the record."""
    spark = run.files.sparkSession
    base, ext = os.path.splitext(path)
    own = F.col("aoi_id") == aoi_id
    z = F.col("z")
    rows = m.bounded(run.chunks.where(own).select("chunk_row", "chunk_col", "suffix", "z", F.col("cx0").alias("x0"), F.col("cy0").alias("y0"), F.col("cx1").alias("x1"), F.col("cy1").alias("y1")), z)
    rows = rows.withColumn("world", images.world_file(F.col("x0"), F.col("y0"), z)).join(run.files.where(own), ["chunk_row", "chunk_col"]).orderBy("chunk_row", "chunk_col")
    files = []

    def put(name: str, data: bytes) -> tuple[str, int]:
        return images.write_atomic(name, data if options.format == "png" else images.encoded(spark, images.from_png(data), options.format, options.quality))

    for r in rows.toLocalIterator():
        name = base + r["suffix"] + ext
        sha, size = put(name, bytes(r["data"]))
        record = {"path": name, "row": r["chunk_row"], "col": r["chunk_col"], "width": r["width"], "height": r["height"], "bytes": size, "sha256": sha, "bounds": {"min_lat": r["south"], "min_lon": r["west"], "max_lat": r["north"], "max_lon": r["east"]}}
        if options.world_file:
            record["world_file"] = base + r["suffix"] + labels.WORLD_FILE[options.format]
            images.write_atomic(record["world_file"], r["world"].encode())
            images.write_atomic(base + r["suffix"] + ".prj", images.PROJECTION.encode())
        files.append(record)
    overview = None
    for r in run.overviews.where(own).toLocalIterator():
        name = f"{base}_overview{ext}"
        sha, size = put(name, bytes(r["data"]))
        overview = {"path": name, "row": 0, "col": 0, "width": r["width"], "height": r["height"], "bytes": size, "sha256": sha}
    record = metadata(run, aoi_id, target, options, files, overview, elapsed, version)
    images.write_atomic(base + ".json", (json.dumps(record, indent=2) + "\n").encode())
    return record


def put_files(files: DataFrame) -> DataFrame:
    """path, bytes, sha256: each task writes its files (path, data), each whole or not at all."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [images.write_atomic(p.as_py(), d.as_py()) for p, d in zip(batch.column("path"), batch.column("data"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([n for _, n in done], pa.int64()), pa.array([s for s, _ in done], pa.string())], names=["path", "bytes", "sha256"])

    return files.select("path", "data").mapInArrow(put, "path string, bytes long, sha256 string")


def records(run: Run, files: DataFrame, overviews: DataFrame, options: RunOptions, version: str = "1") -> DataFrame:
    """aoi_id, record: the JSON description of each area, made where its rows are. What is absent is left out.

    ``files`` and ``overviews`` have the path of each image by aoi_id.
    """
    z = F.col("z")
    counts = [F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("sampled", "ok", "missing", "placeholder", "failed", "sharp", "upsampled")]
    tries = run.attempts.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(F.negative("z").alias("down"), F.struct(F.col("z").alias("zoom"), "tiles", *counts, "accepted", "reason").alias("t")))).alias("tries"))
    gaps = run.resolved.where("kind <> 'native'").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("y", "x", F.struct(F.struct("z", "x", "y").alias("tile"), F.struct("kind", "from_zoom").alias("source")).alias("g")))).alias("gaps"))
    box = lambda: F.struct(F.col("south").alias("min_lat"), F.col("west").alias("min_lon"), F.col("north").alias("max_lat"), F.col("east").alias("max_lon"))
    made = m.bounded(files.select(*KEYS, "z", "path", "chunk_row", "chunk_col", "width", "height", "bytes", "sha256", "world_file", F.col("cx0").alias("x0"), F.col("cy0").alias("y0"), F.col("cx1").alias("x1"), F.col("cy1").alias("y1")), z)
    listed = made.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("chunk_row", "chunk_col", F.struct("path", F.col("chunk_row").alias("row"), F.col("chunk_col").alias("col"), "width", "height", "bytes", "sha256", box().alias("bounds"), "world_file").alias("f")))).alias("files"))
    over = overviews.select(*KEYS, F.struct("path", F.lit(0).alias("row"), F.lit(0).alias("col"), "width", "height", "bytes", "sha256").alias("overview"))
    rows = m.bounded(run.areas, z).join(run.stats, KEYS).join(listed, KEYS).join(tries, KEYS, "left").join(gaps, KEYS, "left").join(over, KEYS, "left")
    metres = [F.round(f(F.col(c), z), 3) for f, c in ((m.px_to_mercator_x, "x0"), (m.py_to_mercator_y, "y1"), (m.px_to_mercator_x, "x1"), (m.py_to_mercator_y, "y0"))]
    asked = F.struct("min_lat", "min_lon", "max_lat", "max_lon")
    record = F.struct(
        F.lit("tilespark").alias("tool"), F.lit(version).alias("version"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"),
        F.struct(F.lit(options.provider).alias("provider"), F.lit(options.template).alias("url_template"), F.lit(options.attribution).alias("attribution")).alias("source"),
        F.struct(asked.alias("requested_bbox"), F.lit(options.clip).alias("clip")).alias("target"),
        F.struct(z.alias("selected"), F.lit(options.zoom.max_zoom).alias("max_requested"), F.lit(options.zoom.min_zoom).alias("min_allowed"), F.transform("tries", lambda t: t["t"]).alias("attempts")).alias("zoom"),
        F.struct(F.round(m.ground_resolution(m.center_lat(), z), 4).alias("ground_m_per_px"), F.round(m.mercator_resolution(z), 6).alias("epsg3857_m_per_px")).alias("resolution"),
        F.struct(F.struct("z", F.col("tx0").alias("x_min"), F.col("ty0").alias("y_min"), F.col("tx1").alias("x_max"), F.col("ty1").alias("y_max")).alias("tile_range"), F.col("tiles").alias("tile_count"), (F.col("x1") - F.col("x0")).alias("pixel_width"), (F.col("y1") - F.col("y0")).alias("pixel_height"), "chunk_rows", "chunk_cols", F.lit(options.chunk).alias("chunk_max_side")).alias("grid"),
        F.struct(box().alias("wgs84"), F.array(*metres).alias("epsg3857")).alias("bounds"),
        F.struct(F.lit("png").alias("format"), F.transform("files", lambda f: f["f"]).alias("files"), "overview").alias("output"),
        F.struct("native", "gap_filled", "placeholder", "empty", F.col("skipped").alias("skipped_outside_clip")).alias("tiles"),
        F.transform("gaps", lambda g: g["g"]).alias("gap_tiles"), (F.col("empty") == 0).alias("complete"),
    )
    return rows.select(*KEYS, F.to_json(record).alias("record"))


def write_files(run: Run, folder: str, options: RunOptions | None = None) -> DataFrame:
    """Tasks write what they hold into a folder that executors share: aoi_id, chunk_row, chunk_col, path, bytes, sha256 of the images.

    Each area gets its chunks as PNG, its overview if it has several, world files and projections if asked for, and
    its JSON record; no image passes the driver. For JPEG, which takes the driver's JVM, see ``write``.
    """
    options = options or RunOptions()
    base = F.concat(F.lit(folder.rstrip("/") + "/aoi"), F.col("aoi_id").cast("string"))
    z = F.col("z")
    keys = [*KEYS, "chunk_row", "chunk_col"]
    side = F.concat(F.col("base"), F.lit(labels.WORLD_FILE["png"])) if options.world_file else F.lit(None).cast("string")
    plan = run.chunks.select(*keys, "z", "cx0", "cy0", "cx1", "cy1", F.concat(base, F.col("suffix")).alias("base")).withColumn("world_file", side)
    named = run.files.join(plan, keys).withColumn("path", F.concat("base", F.lit(".png")))
    overviews = run.overviews.withColumn("path", F.concat(base, F.lit("_overview.png")))
    written = keep(put_files(named.select("path", "data").union(overviews.select("path", "data"))), "written")
    if options.world_file:
        world = plan.select(F.col("world_file").alias("path"), images.world_file(F.col("cx0"), F.col("cy0"), z).cast("binary").alias("data"))
        put_files(world.union(plan.select(F.concat("base", F.lit(".prj")), F.lit(images.PROJECTION).cast("binary")))).agg(F.sum("bytes")).collect()
    told = records(run, named.drop("data"), overviews.drop("data"), options).select(F.concat(base, F.lit(".json")).alias("path"), F.concat("record", F.lit("\n")).cast("binary").alias("data"))
    put_files(told).agg(F.sum("bytes")).collect()
    return named.select(*keys, "path").join(written, "path").select(*keys, "path", "bytes", "sha256")
