"""Judging tiles: filler detection and sharpness, over RGBA tiles in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the two judgements.
SAMPLE_STEP, GREY_SPREAD, GREY_SHARE = 4, 8, 0.97
MODE_LOW, MODE_HIGH, MODE_REACH, MODE_SHARE = 150, 235, 8, 0.75
FLAT, SMOOTH, COARSE, DETAIL = 4.0, 2.0, 16.0, 0.2
LUMA = (0.299, 0.587, 0.114)
LEAST_SIDE = 8


def seen(image: np.ndarray) -> np.ndarray:
    """Red, green and blue as they show on black: pixels that aren't opaque count with their alpha, in 16 bits."""
    if image.shape[2] < 4 or (image[..., 3] == 255).all():
        return image[..., :3]
    wide = image.astype(np.uint32) * 257
    return (wide[..., :3] * wide[..., 3:] // 65535 >> 8).astype(np.uint8)


def grey_levels(rgb: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of samples, and how many of them are grey at each level."""
    some = rgb[::SAMPLE_STEP, ::SAMPLE_STEP, :3].reshape(-1, 3).astype(np.int64)
    grey = some[some.max(axis=1) - some.min(axis=1) <= GREY_SPREAD] if len(some) else some
    return len(some), np.bincount(grey.sum(axis=1) // 3, minlength=256)


def filler_facts(rgb: np.ndarray) -> tuple[int, int, int | None, int, bool]:
    """(samples, grey ones, their commonest level, those near it, whether that makes a filler): nearly all grey, one middle level prevailing."""
    samples, levels = grey_levels(rgb)
    grey, mode = int(levels.sum()), int(levels.argmax())
    if not grey:
        return samples, 0, None, 0, False
    near = int(levels[max(0, mode - MODE_REACH) : mode + MODE_REACH + 1].sum())
    return samples, grey, mode, near, grey >= GREY_SHARE * samples and MODE_LOW <= mode <= MODE_HIGH and near >= MODE_SHARE * samples


def is_filler(rgb: np.ndarray) -> bool:
    return filler_facts(rgb)[-1]


def halved(luma: np.ndarray) -> np.ndarray:
    """Means of two by two; an odd last row or column goes."""
    h, w = luma.shape[0] // 2, luma.shape[1] // 2
    return luma[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3))


def lost_detail(fine: np.ndarray, coarse: np.ndarray) -> float:
    """Mean squared distance, inside the border, from the bilinear picture that the halved one gives."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(1, n - 1) + 0.5) / 2 - 0.5
        low = np.clip(at.astype(np.int64), 0, m - 2)
        return low, at - low

    (y, fy), (x, fx) = axis(fine.shape[0], coarse.shape[0]), axis(fine.shape[1], coarse.shape[1])
    fy, fx = fy[:, None], fx[None, :]
    rows = lambda r: coarse[r[:, None], x] * (1 - fx) + coarse[r[:, None], x + 1] * fx
    return float(np.mean((fine[1:-1, 1:-1] - (rows(y) * (1 - fy) + rows(y + 1) * fy)) ** 2))


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float64) @ np.array(LUMA)


def variance_of(luma: np.ndarray) -> float:
    return float((luma**2).mean() - luma.mean() ** 2)


def sharpness(rgb: np.ndarray) -> tuple[float, float, float]:
    """Energy in the finest octave, in the next, and the variance of the luminance."""
    if min(rgb.shape[:2]) < LEAST_SIDE:
        raise ValueError(f"a tile needs {LEAST_SIDE} pixels a side to be judged")
    luma = luminance(rgb)
    half = halved(luma)
    return lost_detail(luma, half), lost_detail(half, halved(half)), variance_of(luma)


def verdict(top: Column, next_: Column, variance: Column, threshold: float = DETAIL) -> Column:
    """native, upsampled or inconclusive."""
    return (
        F.when(variance < FLAT, "inconclusive")
        .when(next_ < SMOOTH, F.when(variance >= COARSE, "upsampled").otherwise("inconclusive"))
        .when(top / next_ < threshold, "upsampled")
        .otherwise("native")
    )


JUDGED = "z int, x long, y long, status string, error string, fatal boolean, top double, next double, variance double"


def judged(tiles: DataFrame, measure: bool = True, threshold: float = DETAIL) -> DataFrame:
    """z, x, y, status, error, fatal, top, next, variance, verdict for tiles with data. Fillers turn from ok to placeholder."""
    wide = tiles
    for name, kind in (("error", "string"), ("fatal", "boolean")):
        if name not in tiles.columns:
            wide = wide.withColumn(name, F.lit(None).cast(kind))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                status, energy = r["status"], (None, None, None)
                if r["data"] is not None and status == "ok":
                    image = seen(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4))
                    status = "placeholder" if is_filler(image) else "ok"
                    if measure and status == "ok":
                        energy = sharpness(image)
                rows.append((r["z"], r["x"], r["y"], status, r["error"], bool(r["fatal"]), *energy))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in JUDGED.split(", ")])

    out = wide.select("z", "x", "y", "status", "error", "fatal", "width", "height", "data").mapInArrow(judge, JUDGED)
    return out.withColumn("verdict", F.when(F.col("variance").isNotNull(), verdict(F.col("top"), F.col("next"), F.col("variance"), threshold)))


def facts(tiles: DataFrame, of: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """id and ``columns``: what a function says of each image (id, width, height, data), as rows."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["id"], *said) for said in of(seen(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    text = f"id long, {columns}"
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])
    return tiles.select("id", "width", "height", "data").mapInArrow(look, text)


def ranked_levels(rgb: np.ndarray) -> list[tuple[int, int, int]]:
    """(level, samples, rank): grey levels by count, the lowest first among equals."""
    levels = grey_levels(rgb)[1]
    order = np.lexsort((np.arange(256), -levels))
    return [(int(v), int(levels[v]), k + 1) for k, v in enumerate(order.tolist()) if levels[v]]
