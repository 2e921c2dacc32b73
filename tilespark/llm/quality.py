"""Quality: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Each text becomes ``len(NAMES)`` statistics. Cosines of random projections of the
standardised statistics approximate a Gaussian kernel. Each partition sums its
part of the normal equations, for two halves of the labelled rows; a fit on one
half scores the other, and isotonic regression on those scores makes them
probabilities. The final weights come from both halves.

At most ``PER_CLASS`` labelled rows of each label are used (a bounded, documented
sample); statistics and scores cover whole texts of all rows.

Edge cases: null and empty texts have statistics of 0 and a score like others;
without labels of both kinds every score is 0.5; repeated rows score alike; of
different texts that share a labelled id, the one with the smallest hash is learned;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import labels as lab
from tilespark.llm import storage, textkit

NAMES = ("log_bytes", "log_words", "lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "bar", "symbol", "other_mark", "beyond_ascii", "word_length", "word_length_sd", "longest_word", "distinct_words", "distinct_shingles", "repeat_next", "marked_words", "words_a_line")
FOLDS, HELD_OUT = 3, 1
PER_CLASS = 25_000
FEATURES, RIDGE, SEED, WIDTH = 256, 1e-3, 7, 4.0
BINS, LOW, HIGH = 2048, -0.5, 1.5
PARTS = 8

_KIND = np.full(256, 11)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"#$%&*@^~<>{}[]=+\\")):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 12


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    rows, size = len(offs) - 1, np.diff(offs)
    out = np.zeros((rows, len(NAMES)))
    if not len(data):
        return out
    own = np.repeat(np.arange(rows), size)
    kinds = np.bincount(own * 13 + _KIND[data], minlength=rows * 13).reshape(rows, 13)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, row = textkit.words(data, offs)
    h, length = textkit.word_hashes(data, starts, ends), (ends - starts).astype(float)
    n = np.bincount(row, minlength=rows)
    least = np.maximum(n, 1)
    mean = np.bincount(row, length, rows) / least
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / least - mean**2, 0))
    most = np.zeros(rows)
    np.maximum.at(most, row, length)
    kinds_of_words = np.diff(textkit.distinct_sets(h, row, rows)[1])
    s, s_row = textkit.shingles(h, row, rows)
    shingles = np.diff(textkit.distinct_sets(s, s_row, rows)[1])
    again = np.bincount(row[:-1][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) > 1 else np.zeros(rows)
    marked = np.bincount(row[np.isin(_KIND[data[ends - 1]], (7, 8, 9, 10, 11))], minlength=rows)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n)
    for i, kind in enumerate((0, 1, 2, 3, 4, 5, 6, 7, 8, 9)):
        out[:, 2 + i] = share[:, kind]
    out[:, 12] = share[:, 11] + share[:, 10]
    out[:, 13] = share[:, 12]
    out[:, 14], out[:, 15], out[:, 16] = mean, spread, np.log1p(most)
    out[:, 17] = np.log1p(kinds_of_words) / np.log1p(least)
    out[:, 18] = shingles / np.maximum(np.bincount(s_row, minlength=rows), 1)
    out[:, 19], out[:, 20] = again / least, marked / least
    out[:, 21] = np.log1p(n / (1 + kinds[:, 4]))
    return np.minimum(np.sqrt(np.abs(out)), 8)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, to, data, offs in textkit.slices(batch.column("text")):
            values = statistics(data, offs).astype(np.float32)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(to - first + 1) * len(NAMES), pa.int32()), pa.array(values.ravel()))
            part = batch.slice(first, to - first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sum_"), stats], names=["doc_id", "sum_", "stats"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Lift:
    """Random cosines of standardised statistics, and a constant: the score is the kernel's alone."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(SEED)
        turn = x @ rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES)) + rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.cos(turn) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def solved(gram: np.ndarray, cross: np.ndarray, rows: float) -> np.ndarray:
    ridge = np.eye(len(gram)) * RIDGE * max(rows, 1)
    ridge[-1, -1] *= 1e-3
    return np.linalg.solve(gram + ridge, cross)


def isotonic(good: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: for each bin a probability that never falls, from weighted counts by bin. Pooled bins have their common mean; empty ones join those before."""
    blocks: list[list[float]] = []
    for g, n in zip(good, every, strict=True):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n if n else 0.5) for g, n, k in blocks])


@dataclass(frozen=True)
class Model:
    lift: Lift
    weights: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(binned(self.lift(stats) @ self.weights), np.arange(BINS), self.levels)


def binned(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1)


def fitted(stats: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    chosen = storage.staged(lab.sample(labels, "quality", FOLDS, HELD_OUT, per_class), "quality-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    half = (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).cast("int").alias("half")
    # Of texts that share an id, the one with the smallest hash: reruns learn alike.
    first = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("sum_", "stats")).alias("first"), F.first("label").alias("label"), F.first("weight").alias("weight"))
    rows = storage.staged(first.select("first.stats", "label", "weight", half).coalesce(PARTS), "quality-rows")

    width = len(NAMES)
    columns = [F.element_at("stats", i + 1).cast("double") for i in range(width)]
    found = rows.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    if found is None or found[0] is None:
        return None
    lift = Lift(np.array(found[:width], float), np.maximum(np.array(found[width:], float), 1e-3))
    terms = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cross, n = np.zeros((2, terms, terms)), np.zeros((2, terms)), np.zeros(2)
        for batch in batches:
            x, y, w, part = lift(matrix(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("weight").to_numpy(), batch.column("half").to_numpy()
            for k in (0, 1):
                own = part == k
                gram[k] += (x[own] * w[own, None]).T @ x[own]
                cross[k] += x[own].T @ (w[own] * y[own])
                n[k] += w[own].sum()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([g.tobytes() for g in gram], pa.binary()), pa.array([c.tobytes() for c in cross], pa.binary()), pa.array(n)], names=["half", "gram", "cross", "n"])

    gram, cross, n = np.zeros((2, terms, terms)), np.zeros((2, terms)), np.zeros(2)
    for r in rows.mapInArrow(sums, "half int, gram binary, cross binary, n double").toLocalIterator():
        gram[r["half"]] += np.frombuffer(r["gram"]).reshape(terms, terms)
        cross[r["half"]] += np.frombuffer(r["cross"])
        n[r["half"]] += r["n"]
    if not n.all():
        return None
    other = [solved(gram[1 - k], cross[1 - k], n[1 - k]) for k in (0, 1)]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, part = lift(matrix(batch.column("stats"))), batch.column("half").to_numpy()
            raw = np.where(part == 0, x @ other[0], x @ other[1])
            yield pa.RecordBatch.from_arrays([pa.array(binned(raw).astype(np.int32)), batch.column("label"), batch.column("weight")], names=["bin", "label", "weight"])

    good, every = np.zeros(BINS), np.zeros(BINS)
    for r in rows.mapInArrow(counts, "bin int, label int, weight double").groupBy("bin").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect():
        good[r["bin"]], every[r["bin"]] = r["good"], r["n"]
    return Model(lift, solved(gram.sum(0), cross.sum(0), n.sum()), isotonic(good, every))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    stats = storage.staged(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("sum_"), "text").mapInArrow(measured, "doc_id long, sum_ long, stats array<float>"), "quality-stats")
    model = fitted(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("stats"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (lab.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "labels"))
