"""Near-deduplication where ids repeat, buckets are hot and groups are large."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tilespark.llm import components, near_dedup, storage


def kept(frame, pairs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in near_dedup.deduped(frame(pairs)).collect())


def expected(pairs):
    return sorted((i is None, i or 0, t or "") for i, t in pairs)


def test_different_texts_of_one_id_all_stay(frame):
    pairs = [(1, "a"), (1, "b"), (2, "c"), (None, "d e f g h i j"), (None, "k l m n o p q"), (None, None), (None, "")]
    assert kept(frame, pairs) == expected(pairs)


def test_one_row_of_a_component_stays_whatever_the_ids(frame):
    base, other = words(1, 80), words(2, 80)
    near = [*base[:40], "new", *base[41:]]
    texts = [" ".join(t) for t in (base, near, other)]
    pairs = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[0]), (7, texts[1]), (None, texts[0]), (3, texts[2]), (3, texts[2])]
    out = kept(frame, pairs)
    assert len(out) == 2 and out[0] == (False, 3, texts[2]) and out[1][:2] == (False, 5) and out[1][2] in texts[:2]
    assert kept(frame, pairs[::-1]) == out


def test_a_row_without_id_stays_only_for_want_of_others(frame):
    text, other = " ".join(words(3, 50)), " ".join(words(4, 50))
    assert kept(frame, [(None, text), (9, text), (None, other), (None, other)]) == expected([(9, text), (None, other)])


@pytest.fixture
def counted(monkeypatch):
    """Rows of each staged table, by name: the largest."""
    rows, real = Counter(), storage.staged

    def staged(df, name):
        out = real(df, name)
        rows[name] = max(rows[name], out.count())
        return out

    monkeypatch.setattr(storage, "staged", staged)
    return rows


def test_rows_follow_members_of_a_large_group(spark, counted):
    """6000 variants of one text, a third of the table under one id, among other texts."""
    base = words(11, 60)
    rows = [(i, " ".join([*base[: i % 60], f"v{i}", *base[i % 60 + 1 :]]) if i % 2 else " ".join(base)) for i in range(6_000)]
    rows += [(7, f"{t} again") for _, t in rows[:3_000]] + [(50_000 + i, " ".join(words(100 + i, 40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = near_dedup.membership(docs)
    assert {r[0]: r[1] for r in out.groupBy("component_id").count().where("count > 1").collect()} == {0: 9_000}
    nodes = counted["shingle-nodes"]
    assert counted["near-members"] <= 64 * nodes and counted["near-tiles"] <= nodes and counted["near-found"] <= nodes


def test_tiles_are_linear_in_the_linked_group(spark, monkeypatch):
    """One bucket of 20 000 nodes: 300 strays make few rows more; blocks of shingles keep long texts apart."""
    members = spark.range(20_000).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"), F.greatest("id", F.lit(19_700)).alias("label"), F.lit(50).cast("long").alias("n"))
    found = near_dedup.tiles(members)
    assert found.count() <= 20_000 + 300 * 21
    assert {r["lo"]: r["count"] for r in found.where(F.col("side") == near_dedup.SEEKER).groupBy("lo", "hi").count().collect()} == {0: 299}
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 20_000)
    assert len({tuple(r) for r in near_dedup.tiles(members).select("lo", "hi").distinct().collect()}) == 50


def test_every_pair_of_labels_meets_in_some_tile(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(int(b), n, int(rng.integers(0, 12)) if b else n % 3, 20) for b in (0, 1) for n in range(60)]
    label = {(b, n): k for b, n, k, _ in rows}
    tiles = {}
    for r in near_dedup.tiles(spark.createDataFrame(rows, "bucket long, node long, label long, n long")).collect():
        tiles.setdefault((r["bucket"], r["lo"], r["hi"]), []).append((r["node"], r["side"]))
    met = Counter()
    for (b, _, _), members in tiles.items():
        for i, one in members:
            for j, other in members:
                if one == near_dedup.SEEKER != other and label[b, i] != label[b, j] and (other == near_dedup.MAIN or j > i):
                    met[b, min(i, j), max(i, j)] += 1
    assert met == Counter({(b, i, j): 1 for b in (0, 1) for i in range(60) for j in range(i + 1, 60) if label[b, i] != label[b, j]})


def test_first_meeting_is_the_first_shared_bucket():
    rng = np.random.default_rng(7)
    one = rng.integers(0, 3, (40, near_dedup.SYMBOLS)).astype(np.uint16)
    keys = []
    for i in range(40):
        rows = one[i].reshape(near_dedup.CHUNKS, near_dedup.WIDTH)
        keys.append([(c, o, *(rows[c][[k for k in range(near_dedup.WIDTH) if k != o]])) for c in range(near_dedup.CHUNKS) for o in range(near_dedup.WIDTH)])
    for i in range(40):
        for j in range(i):
            shared = [k for k, (x, y) in enumerate(zip(keys[i], keys[j], strict=True)) if x == y]
            if shared:
                agree = np.packbits(one[i] == one[j], bitorder="little").view(np.uint64)
                assert near_dedup.first_meeting(agree)[0] == shared[0]


def test_hot_centre_of_components(spark):
    edges = spark.range(1, 30_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(30_000, 30_050).select("id", F.col("id") + 1))
    out = components.labels(edges).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 30_000, 30_000: 51}


def test_shuffled_lists_agree_with_broadcast_ones(frame, monkeypatch):
    pairs = [(i % 40, " ".join([*words(i % 12, 60), *(["end"] if i % 2 else [])])) for i in range(80)]
    plain = kept(frame, pairs)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert kept(frame, pairs) == plain and len(plain) == 12
