"""The command line: one area of interest, as text, to images and a record of them.

Exit codes: 0 written, 1 failed, 2 wrong usage, 3 written with tiles that have no imagery.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import labels
from tilespark.operators import zoom
from tilespark.plans import layout, run, store
from tilespark.sources import geojson, http, targets

VERSION = "1"
OK, FAILED, USAGE, PARTIAL = range(4)

#: name: (aliases, kind, default)
FLAGS = {
    "out": (("o", "out"), str, ""), "radius": (("r", "radius"), float, targets.DEFAULT_RADIUS), "zoom": (("z", "zoom"), int, 23), "quality": (("q", "quality"), int, 90),
    "workers": (("j", "workers"), int, 16), "clip": (("clip",), bool, False), "world": (("world",), bool, False), "dry_run": (("n", "dry-run"), bool, False), "quiet": (("quiet",), bool, False),
    "version": (("version",), bool, False), "min_zoom": (("min-zoom",), int, 1), "max_tiles": (("max-tiles",), int, layout.DEFAULT_TILES), "chunk": (("chunk",), int, layout.DEFAULT_CHUNK),
    "coverage": (("coverage",), float, 0.5), "detail": (("detail",), float, 0.2), "url": (("url",), str, ""), "token": (("token",), str, ""),
}
HELP = "usage: tilespark [flags] TARGET\nTARGET: lat,lon | lat,lon,lat,lon | file.geojson | - (GeoJSON from stdin)\nflags: " + " ".join("-" + "/-".join(names) for names, _, _ in FLAGS.values())


class Wrong(ValueError):
    pass


@dataclass
class Given:
    flags: dict
    targets: list[str]


def looks_numeric(text: str) -> bool:
    rest = text.removeprefix("-")
    return bool(rest) and (rest[0] in "0123456789.")


def split(args: list[str]) -> Given:
    """Flags and targets in any order; negative numbers are targets; all after -- are targets."""
    kinds = {alias: (name, kind) for name, (aliases, kind, _) in FLAGS.items() for alias in aliases}
    out = Given({name: default for name, (_, _, default) in FLAGS.items()}, [])
    i = 0
    while i < len(args):
        a = args[i]
        i += 1
        if a == "--":
            out.targets += args[i:]
            break
        if a == "-" or not a.startswith("-") or looks_numeric(a):
            out.targets.append(a)
            continue
        alias, given, value = a.lstrip("-").partition("=")
        if alias in ("h", "help"):
            raise SystemExit(HELP)
        if alias not in kinds:
            raise Wrong(f"flag provided but not defined: -{alias}")
        name, kind = kinds[alias]
        if kind is bool:
            out.flags[name] = value.lower() not in ("false", "0", "f") if given else True
            continue
        if not given:
            if i == len(args):
                raise Wrong(f"flag needs an argument: -{alias}")
            value = args[i]
            i += 1
        try:
            out.flags[name] = kind(value)
        except ValueError:
            raise Wrong(f'invalid value "{value}" for flag -{alias}') from None
    return out


def options(f: dict, kind: str) -> run.RunOptions:
    return run.RunOptions(zoom.ZoomOptions(f["zoom"], f["min_zoom"], f["max_tiles"], f["coverage"], f["detail"]), f["chunk"], kind, f["quality"], f["clip"], f["world"], template=f["url"], workers=f["workers"])


def area_of(spark: SparkSession, text: str, radius: float, stdin: TextIO) -> tuple[DataFrame, dict, DataFrame | None]:
    """(the area, its description, its polygons' positions) of one target."""
    one = spark.createDataFrame([(0, text)], "aoi_id long, input string")
    found = targets.parsed(one, F.lit(radius))
    row = found.first()
    positions = None
    if row["kind"] in ("given", "file"):
        if row["kind"] == "given":
            body, name = stdin.read(), "stdin"
        elif os.path.exists(text):
            body, name = "\n".join(r[0] for r in spark.read.text(os.path.abspath(text), wholetext=True).collect()), text
        else:
            raise Wrong(f'"{text}" is neither coordinates (lat,lon or lat1,lon1,lat2,lon2) nor an existing GeoJSON file')
        positions = geojson.positions(spark.createDataFrame([(0, body)], "aoi_id long, geojson string"))
        found = geojson.areas(positions, F.lit(radius))
        row = found.first()
        if row["error"]:
            raise Wrong(f"{name}: {row['error']}")
    elif row["error"]:
        raise Wrong(row["error"])
    box = {c: row[c] for c in ("min_lat", "min_lon", "max_lat", "max_lon")}
    target = {"kind": row["kind"], "input": text} | ({"radius_m": radius} if row["kind"] == "point" else {}) | {"requested_bbox": box, "polygons": row["polygons"] if positions is not None else 0}
    return spark.createDataFrame([(0, *box.values())], "aoi_id long, min_lat double, min_lon double, max_lat double, max_lon double"), target, positions


def dry_run(area: DataFrame, target: dict, f: dict, out: TextIO) -> None:
    b = target["requested_bbox"]
    print(f"target   {target['input']} ({target['kind']})\nbbox     lat {b['min_lat']:.6f}..{b['max_lat']:.6f}  lon {b['min_lon']:.6f}..{b['max_lon']:.6f}\n", file=out)
    print(f"{'zoom':>4}  {'m/px':>9}  {'tiles':>8}  {'pixels':>15}  {'images':>7}  note", file=out)
    for r in layout.dry_run(area, ["aoi_id"], f["zoom"], f["min_zoom"], f["chunk"], f["max_tiles"]).orderBy(F.desc("z")).collect():
        size = f"{r['width']}x{r['height']}"
        print(f"{r['z']:>4}  {r['meters_a_pixel']:>9.3f}  {r['tiles']:>8}  {size:>15}  {r['images']:>7}  {r['note']}", file=out)


def main(args: list[str], spark: Callable[[], SparkSession], stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr, source: run.Source | None = None) -> int:
    """Runs the command. ``source`` replaces the HTTP tile source."""
    try:
        given = split(args)
    except SystemExit as e:
        print(e, file=err)
        return OK
    except Wrong as e:
        print("error:", e, file=err)
        return USAGE
    f = given.flags
    if f["version"]:
        print("tilespark", VERSION, file=out)
        return OK
    if len(given.targets) != 1:
        print(HELP if not given.targets else f"{HELP}\nerror: expected one target, got {len(given.targets)}", file=err)
        return USAGE
    path = f["out"] or time.strftime("tiles-%Y%m%d-%H%M%S.png")
    try:
        wish = options(f, "png")
        if source is None and not f["dry_run"] and not all(p in f["url"] for p in ("{z}", "{x}", "{y}")) or f["url"] and not all(p in f["url"] for p in ("{z}", "{x}", "{y}")):
            raise Wrong("-url must contain {z}, {x} and {y}")
        session = spark()
        area, target, positions = area_of(session, given.targets[0], f["radius"], stdin)
        if f["clip"] and not target["polygons"]:
            raise Wrong("-clip needs a GeoJSON target with Polygon or MultiPolygon geometry")
        kind = labels.FORMATS.get(os.path.splitext(path)[1].lower())
        if kind is None:
            raise Wrong(f'unsupported output extension "{os.path.splitext(path)[1]}" (use .webp, .jpg or .png)')
        wish = options(f, kind)
    except ValueError as e:
        print("error:", e, file=err)
        return USAGE
    if f["dry_run"]:
        dry_run(area, target, f, out)
        return OK
    began = time.time()
    token = f["token"] or os.environ.get("TILE_TOKEN", "")
    read = source or http.TileSource(f["url"], token, f["workers"])
    try:
        if kind == "webp":
            raise RuntimeError("webp output needs an encoder that is not installed; use .png or .jpg")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        made = run.execute(area, read, wish, positions, (lambda text: None) if f["quiet"] else (lambda text: print(text, file=err)))
        outcome = made.outcomes.first()
        if outcome["outcome"] != "ok":
            said = {"too_large": "area too large for the tile budget at every zoom", "none": "no imagery found at any zoom", "unreachable": "tile server unreachable", "fatal": "tile server refused request"}
            raise run.NoImagery(outcome["error"] if outcome["outcome"] == "fatal" else ": ".join(x for x in (said[outcome["outcome"]], outcome["error"]) if x))
        record = run.write(made, 0, path, target, wish, time.time() - began, VERSION)
    except (RuntimeError, OSError) as e:
        print("error:", labels.redact(str(e)), file=err)
        return FAILED
    finally:
        store.clear(session)
    files = record["output"]["files"]
    total = sum(x["bytes"] for x in files)
    size = session.range(1).select(labels.human_bytes(F.lit(total))).first()[0]
    if len(files) == 1:
        print(f"{files[0]['path']}  {files[0]['width']}x{files[0]['height']}  {size}", file=out)
    else:
        print(f"{len(files)} images ({record['grid']['chunk_rows']}x{record['grid']['chunk_cols']} grid)  {size} total", file=out)
        print(f"{record['output']['overview']['path']}  overview", file=out)
    print(f"{os.path.splitext(path)[0]}.json  metadata", file=out)
    if record["tiles"]["empty"]:
        print(f"warning: {record['tiles']['empty']} tile(s) had no imagery at any zoom", file=err)
        return PARTIAL
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], lambda: SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()))
