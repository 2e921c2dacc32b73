"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the words, word pairs, and pairs with one word between,
lower-cased, without punctuation, hashed into ``DIMENSIONS`` places; each counts
once. The learner keeps a rate for each coordinate; its L1 term leaves a sparse
list of weights, which is all that goes to the scoring tasks.

The learner sees at most ``PER_CLASS`` labelled rows of each label (a bounded,
documented sample, the first by a hash of the id, the rest made up for by
weight); scores cover whole texts of all rows.

Edge cases: null and empty texts score by the intercept alone; without labels of
both kinds every score is 0; repeated rows score alike; of different texts that share
a labelled id, the one with the smallest hash is learned; other columns are kept by
``rejected`` and ignored by ``scores``; rows without id are scored like others; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import labels as lab
from tilespark.llm import storage, textkit

DIMENSIONS = 1 << 22
PER_CLASS = 15_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 1.0, 3


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each feature, repeats included, and its row."""
    starts, ends, row = textkit.words(data, offs, textkit.NOT_LETTERS)
    h = textkit.word_hashes(data, starts, ends)
    found, rows = [h], [row]
    for gap, salt in ((1, 0x51ED270B0B2C4A35), (2, 0x2545F4914F6CDD1D)):
        inside = np.flatnonzero(row[:-gap] == row[gap:]) if len(h) > gap else np.zeros(0, np.int64)
        found.append(textkit.mix(h[inside] * np.uint64(salt) + h[inside + gap]))
        rows.append(row[inside])
    return (np.concatenate(found) >> np.uint64(64 - 22)).astype(np.int32), np.concatenate(rows)


def feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each labelled text, as int32 bytes."""
    for batch in batches:
        for first, to, data, offs in textkit.slices(batch.column("text")):
            place, row = features(data, offs)
            values, at = textkit.distinct_sets(place[np.argsort(row, kind="stable")], np.sort(row, kind="stable"), to - first)
            part = batch.slice(first, to - first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("weight"), textkit.binary_column(values, at)], names=["doc_id", "label", "weight", "places"])


def ftrl(texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't 0; place ``DIMENSIONS`` is the intercept's, which has no L1 term."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    z0 = n0 = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(epochs):
        for places, y, c in zip(texts, label, weight, strict=True):
            zi, ni = z[places], n[places]
            w, w0 = weights(zi, ni, L1), float(weights(z0, n0, 0.0))
            g = c * (1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y)
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[places] = ni + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    return np.append(used, DIMENSIONS), np.append(weights(z[used], n[used], L1), weights(z0, n0, 0.0))


def learned(table: pa.Table) -> pa.Table:
    """One group, bounded by the sample: its rows in a fixed order, to the list of weights. Features are read where they lie."""
    ids, label, weight = (table.column(c).to_numpy() for c in ("doc_id", "label", "weight"))
    _, once = np.unique(ids, return_index=True)  # rows of one id are alike here
    order = once[np.argsort(textkit.mix(ids[once].astype(np.uint64)), kind="stable")]
    texts: list[np.ndarray] = []
    for chunk in table.column("places").chunks:
        data, offs = textkit.buffers(chunk)
        texts += [data[a:b].view(np.int32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    places, values = ftrl([texts[i] for i in order], label[order], weight[order])
    return pa.table({"place": pa.array(places, pa.int32()), "value": pa.array(values, pa.float64())})


def model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray] | None:
    """The sparse weights, at most one for each place; None without labels of both kinds."""
    chosen = storage.staged(lab.sample(labels, "toxic", FOLDS, HELD_OUT, per_class), "toxic-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("sum_"), "text")
    # Of texts that share an id, the one with the smallest hash. Only ids and hashes are shuffled for that, and the list is as short as the sample.
    first = rows.select("doc_id", "sum_").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("sum_").alias("sum_"), F.first("label").alias("label"), F.first("weight").alias("weight"))
    texts = rows.join(F.broadcast(storage.staged(first, "toxic-firsts")), ["doc_id", "sum_"])
    sets = texts.select("doc_id", "label", "weight", "text").mapInArrow(feature_sets, "doc_id long, label int, weight double, places binary")
    found = sets.withColumn("group", F.lit("all")).groupBy("group").applyInArrow(learned, "place int, value double").toArrow()
    if not found.num_rows:
        return None
    return found.column("place").to_numpy(), found.column("value").to_numpy()


def scorer(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None) -> Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Makes, in a task, the function from texts (bytes, offsets) to scores in [0, 1]."""
    if weights is None:
        return lambda: lambda data, offs: np.zeros(len(offs) - 1)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def in_task() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        dense = np.zeros(DIMENSIONS + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]

        def score(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
            place, row = features(data, offs)
            hit = np.flatnonzero(dense[place])
            pairs = np.unique(row[hit] * (DIMENSIONS + 1) + place[hit])
            total = np.bincount(pairs // (DIMENSIONS + 1), dense[pairs % (DIMENSIONS + 1)].astype(np.float64), len(offs) - 1) + float(dense[-1])
            return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

        return score

    return in_task


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    make = scorer(docs, model(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for first, to, data, offs in textkit.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, to - first), pa.array(score(data, offs))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", (lab.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more."""
    make = scorer(docs, model(docs, labels))

    def free() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        score = make()
        return lambda data, offs: score(data, offs) < THRESHOLD

    return textkit.filtered(docs, free)


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "labels"))
