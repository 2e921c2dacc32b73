"""The two learners against plain fits on the same rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tilespark.llm import quality, textkit, toxicity


@pytest.fixture(scope="module")
def labelled(spark, frame):
    """240 documents with two words or a case that say the label; some ids have a second text, some rows repeat."""
    pairs = [(i, " ".join([*words(i, 40, 200), *(["vile", "foul"] if i % 3 == 0 else [])])) for i in range(240)]
    pairs = [(i, t.upper() if i % 4 == 0 else t) for i, t in pairs]
    pairs += [(i, " ".join(words(i + 900, 30, 200))) for i in range(0, 40, 5)] + pairs[:10]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(220)], "doc_id long, quality int, toxic int")
    return pairs, frame(pairs), labels


def learned_texts(spark, pairs, held_out):
    """id to text for rows that may be learned: of several texts the one with the smallest hash."""
    rows = spark.createDataFrame(sorted(set(pairs)), "doc_id long, text string").where("doc_id < 220").select("doc_id", "text", F.xxhash64("text").alias("h"), (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).cast("int").alias("half")).orderBy("doc_id", "h").collect()
    out, half = {}, {}
    for r in rows:
        if not held_out(r["doc_id"]):
            out.setdefault(r["doc_id"], r["text"])
            half[r["doc_id"]] = r["half"]
    return out, half


def data_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_toxicity_weights_are_those_of_a_plain_learner(spark, labelled):
    pairs, docs, labels = labelled
    texts, _ = learned_texts(spark, pairs, lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    order = sorted(texts, key=lambda i: int(textkit.mix(np.array([i], np.uint64))[0]))
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == "all" else toxicity.L1
        zi = z.get(k, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            places = ["all", *sorted(set(toxicity.features(*data_of(texts[i]))[0].tolist()))]
            w = {k: weight(k) for k in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - int(i % 3 == 0)
            for k in places:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
    plain = {toxicity.DIMENSIONS if k == "all" else k: weight(k) for k in z}
    got = dict(zip(*(v.tolist() for v in toxicity.model(docs, labels)), strict=True))
    assert {k for k, v in plain.items() if v} == {k for k, v in got.items() if v}
    assert all(abs(got[k] - plain[k]) < 1e-6 for k in got)


def test_quality_scores_are_those_of_a_plain_fit(spark, labelled):
    pairs, docs, labels = labelled
    texts, half = learned_texts(spark, pairs, lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    ids = sorted(texts)
    stats = np.vstack([quality.statistics(*data_of(texts[i])) for i in ids]).astype(np.float32).astype(float)
    label, part = np.array([i % 4 != 0 for i in ids], float), np.array([half[i] for i in ids])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    x = quality.Lift(mean, scale)(stats)

    def ridge(rows):
        penalty = np.full(x.shape[1], quality.RIDGE * len(rows))
        penalty[-1] *= 1e-3
        return np.linalg.lstsq(np.vstack([x[rows], np.diag(np.sqrt(penalty))]), np.concatenate([label[rows], np.zeros(x.shape[1])]), rcond=None)[0]

    raw = np.where(part == 0, x @ ridge(np.flatnonzero(part == 1)), x @ ridge(np.flatnonzero(part == 0)))
    place = quality.binned(raw).astype(int)
    levels = quality.isotonic(np.bincount(place, label, quality.BINS), np.bincount(place, minlength=quality.BINS).astype(float))
    model = quality.Model(quality.Lift(mean, scale), ridge(np.arange(len(ids))), levels)
    got = {(r["doc_id"], round(r["score"], 9)) for r in quality.scores(docs, labels).collect()}
    plain = {(i, model.score(quality.statistics(*data_of(t)).astype(np.float32).astype(float))[0]) for i, t in pairs}
    assert len(got) <= len(plain)
    for i, s in plain:
        assert min(abs(s - v) for k, v in got if k == i) < 1e-6
    again = {(r["doc_id"], round(r["score"], 9)) for r in quality.scores(docs.repartition(5), labels).collect()}
    assert all(min(abs(v - w) for j, w in again if j == k) < 1e-6 for k, v in got)
