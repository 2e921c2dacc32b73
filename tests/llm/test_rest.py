"""Classifiers, sharding, mixing, decontamination, PII and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import messy_pairs, words
from tests.llm.test_dedup import shingle_set
from tilespark.llm import decontamination, mixing, pii, quality, sharding, textkit, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def size(text):
    return len((text or "").encode()) + 1


@pytest.fixture(scope="module")
def labelled(spark, frame):
    """300 documents, a third of them toxic by their words, another part junk; labels for most, with nulls and repeats."""
    pairs, rows = [], []
    for i in range(300):
        text = words(i, 60, 300)
        if i % 3 == 0:
            for k in range(4):
                text.insert(k * 11, random.Random(i + k).choice(["vile", "rotten", "foul"]))
        if i % 5 == 0:
            text = [w.upper() + "!!" for w in text]
        pairs.append((i, " ".join(text)))
        if i % 10:
            rows.append((i, int(i % 5 != 0), int(i % 3 == 0)))
    rows += [(1, 1, 0), (None, 1, 1), (7, None, None), (9999, 0, 1)]
    return frame(pairs), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    out = toxicity.scores(docs, labels).collect()
    assert len(out) == 300
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.9 * len(held)


def test_quality_held_out(labelled):
    docs, labels = labelled
    out = quality.scores(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 300 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held) >= 0.9 * len(held)


def test_classifiers_on_odd_tables(spark, messy, empty, labelled):
    labels, none = labelled[1], spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = len(messy_pairs())
    for score, given in ((toxicity.scores, 0.0), (quality.scores, 0.5)):
        assert score(messy, labels).count() == n
        assert {r["score"] for r in score(messy, none).collect()} == {given}
        assert score(empty, labels).count() == 0 and score(empty, none).count() == 0
    kept = toxicity.rejected(messy, none)
    assert kept.columns == messy.columns and kept.count() == n


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_never_falls_and_keeps_means(seed):
    """Against the minimax form: the level of a bin is the least, over ends at or after it, of the greatest mean over starts at or before it."""
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 9, 60).astype(float)
    n[0] += 1
    good = np.minimum(n, rng.poisson(n * np.linspace(0.1, 0.9, 60)))
    level = quality.isotonic(good, n)
    mean = lambda i, j: good[i : j + 1].sum() / n[i : j + 1].sum() if n[i : j + 1].sum() else -1.0
    plain = [min(max(mean(i, j) for i in range(k + 1)) for j in range(k, 60)) for k in range(60) if n[k]]
    assert np.allclose(level[n > 0], plain) and (np.diff(level) >= 0).all() and np.isclose((level * n).sum(), good.sum())
    assert (np.diff(quality.isotonic(np.array([0.0, 0, 90, 1]), np.array([10.0, 5, 100, 1]))) >= 0).all()


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(3)
    texts, label = [], []
    for i in range(200):
        places = rng.choice(5000, 40, replace=False)
        if i % 2:
            places = np.append(places, 6000)
        texts.append(places.astype(np.int32))
        label.append(i % 2)
    places, values = toxicity.ftrl(texts, np.array(label), np.ones(200))
    assert len(places) < 400 and dict(zip(places.tolist(), values.tolist(), strict=True))[6000] > 1


def test_shards_are_balanced_and_gapless(spark, messy, empty, frame):
    pairs = [(i, " ".join(words(i, 1 + i % 17))) for i in range(6000)]
    out = sharding.positions(frame(pairs), 16).collect()
    by = defaultdict(list)
    load = Counter()
    texts = dict(pairs)
    for r in out:
        text = texts[r["doc_id"]]
        assert r["size"] == size(text) and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(load.values()) <= 1.02 * min(load.values()) and {r["map_version"] for r in out} == {2}
    out = sharding.positions(messy, 16).collect()
    assert len(out) == len(messy_pairs())
    assert all(sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out))) for k in range(16))
    assert sharding.positions(empty, 16).count() == 0
    again = messy.withColumn("shard", F.lit("mine"))
    assert sharding.assign(again, sharding.even_map(64, 4)).columns == [*messy.columns, "shard_before", "shard"]


def test_equal_texts_share_a_shard(frame):
    """Copies of many texts, one of them a third of all bytes: groups stay whole and the other shards are even."""
    pairs = [(i, " ".join(words(i % 900, 30))) for i in range(2700)] + [(10_000 + i, " ".join(words(5, 30))) for i in range(1300)] + [(None, None), (None, ""), (7, None)]
    out = sharding.positions(frame(pairs), 8).collect()
    by_text, load = defaultdict(set), Counter()
    for r in out:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) == 901
    *rest, most = sorted(load.values())
    assert most >= 1300 * 100 and max(rest) <= 1.05 * min(rest)


def test_rebalancing_edits_the_map():
    rng = random.Random(1)
    sums = [rng.randrange(1, 1000) for _ in range(512)]
    load = lambda m, s: [sum(b for b, k in zip(s, m.shards, strict=True) if k == j) for j in range(m.n_shards)]
    first = sharding.rebalanced(sharding.even_map(512, 16), sums)
    assert max(load(first, sums)) <= 1.01 * min(load(first, sums)) and first.version == 2
    grown = sharding.rebalanced(first, sums, 17)
    moved = [i for i in range(512) if grown.shards[i] != first.shards[i]]
    assert grown.version == 3 and max(load(grown, sums)) <= 1.06 * min(load(grown, sums)) and len(moved) < 120
    later = [b * (5 if i % 16 == 3 else 1) for i, b in enumerate(sums)]
    again = sharding.rebalanced(first, later)
    assert max(load(again, later)) <= 1.05 * min(load(again, later)) and sum(a != b for a, b in zip(again.shards, first.shards, strict=True)) < 200
    fewer = sharding.rebalanced(first, sums, 15)
    assert max(fewer.shards) == 14
    heavy = [100_000, *sums[1:]]
    rest = sorted(load(sharding.rebalanced(first, heavy), heavy))[:-1]
    assert max(rest) <= 1.01 * min(rest)


def test_maps_are_stored_read_back_and_edited(spark, frame, tmp_path):
    folder = f"{tmp_path}/maps"
    assert sharding.SlotMap.load(spark, folder) is None
    pairs = [(i, " ".join(words(i, 20))) for i in range(400)]
    one = {(r["doc_id"], r["map_version"]): r["shard"] for r in sharding.positions(frame(pairs), 4, 64, folder).collect()}
    same = {(r["doc_id"], r["map_version"]): r["shard"] for r in sharding.positions(frame(pairs), 4, 64, folder).collect()}
    assert one == same and {v for _, v in one} == {2}
    more = {(r["doc_id"], r["map_version"]): r["shard"] for r in sharding.positions(frame(pairs), 5, 64, folder).collect()}
    stored = sharding.SlotMap.load(spark, folder)
    assert {v for _, v in more} == {3} and (stored.version, stored.n_shards, len(stored.shards)) == (3, 5, 64)
    assert all(more[d, 3] in (shard, 4) for (d, _), shard in one.items())


def brute_targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        share = sum(w for s, w in weights.items() if s not in fixed)
        now = {s: rest * w / share for s, w in weights.items() if s not in fixed} if share else {}
        over = [s for s, t in now.items() if t > 3 * sizes[s] + 1e-9]
        if not over:
            return now | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_targets(spark, messy, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(words(i, rng.randrange(1, 60))), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan(docs).collect()
    sizes, taken = Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(t.split())
    target = brute_targets(sizes)
    for r in out:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9) and r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] for s in sizes)
    assert {(r["doc_id"], r["taken"]) for r in mixing.plan(docs).collect()} == {(r["doc_id"], r["taken"]) for r in out}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and Counter(r[0] for r in mixed.select("doc_id").collect()) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})
    assert len(mixing.plan(messy).collect()) == len(messy_pairs()) and mixing.mixed(messy).columns == messy.columns
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_targets_of_many_sources_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(None if k == 700 else f"s{k:04d}", rng.randrange(0, 10 ** rng.randrange(1, 6))) for k in range(701) for _ in range(2)]
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    target = brute_targets(sizes)
    for part in (100, 1, 100_000):
        monkeypatch.setattr(mixing, "SOURCES_A_PART", max(part, 30))
        got = {r["source"]: r["target"] for r in mixing.rates(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert got.keys() == target.keys() and all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-6) for s in got)


def test_containment_against_sets(spark, messy, empty, frame):
    items = [(k, " ".join(words(900 + k, 6 + 4 * k))) for k in range(12)] + [(50, None), (51, ""), (52, "one two three"), (0, " ".join(words(900, 6))), (None, "one two three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pairs = list(messy_pairs())
    for i in range(200, 260):
        rng = random.Random(i)
        item = words(900 + i % 12, 6 + 4 * (i % 12))
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "edit"
        pairs.append((i, " ".join([*words(i, rng.randrange(200)), *item, *words(i + 5, rng.randrange(50))])))
    expected = set()
    for d, t in pairs:
        for k, item in set(items):
            own = shingle_set(item)
            shared = len(own & shingle_set(t))
            if own and k is not None and 100 * shared >= 75 * len(own):
                expected.add((d, k, len(own), shared))
    docs = frame(pairs)
    got = {tuple(r) for r in decontamination.contained(docs, benchmark).collect()}
    assert got == expected and len(got) > 20
    dirty = {d for d, *_ in expected}
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(d for d, _ in pairs if d not in dirty)
    assert decontamination.contained(empty, benchmark).count() == 0 and decontamination.contained(messy, benchmark.limit(0)).count() == 0


def test_containment_in_many_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 10)
    items = [(k, " ".join(words(900 + k, 20))) for k in range(5)]
    docs = frame([(k, "before it " + t + " after") for k, t in items] + [(9, "nothing to see in this one here")])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for wave in (1, 2, 8):
        monkeypatch.setattr(decontamination, "WAVE", wave)
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, benchmark).collect()} == {(k, k) for k in range(5)}
    monkeypatch.setattr(decontamination, "WAVE", 2)
    assert [r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()] == [9]


# The four base kinds, by the plain patterns.
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def right(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE) for m in p.finditer(text or "") if right(kind, m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_pii_base_spans(frame, messy, empty):
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y+z%1@mail-1.example.com", "a@b.c_d@e.f", "@x.y", "a@b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "1" * 25, "12 34", "+1 (555) 123-4567", "+1-5", "+44.20.7946.0958", "++12 345 678 901", "ñandú", "😀", " ", "  ", "\n", ",", "word", "7", ".", "-", "0" * 3000, "a" * 3000, "1 " * 2000]
    pairs = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(0, 14)))) for i in range(200)] + list(messy_pairs())
    texts = defaultdict(list)
    for i, t in pairs:
        texts[i].append(t)
    for r in pii.identifiers(frame(pairs)).collect():
        options = [base_spans(t) for t in texts[r["doc_id"]]]
        own = [b for b in options if hashlib.sha256(b.encode()).hexdigest() == r["base_sha256"]]
        assert own, (r["doc_id"], r["spans"])
        assert set(own[0].split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k, _ in BASE] == [own[0].count(f"{k}:") for k, _ in BASE]
    assert pii.identifiers(empty).count() == 0


def test_pii_contexts_find_unseen_identifiers(frame):
    pairs = []
    for i in range(60):
        pairs.append((i, f"text before contact: user{i}@mail.example and more; the year 20{i:02d} was"))
    pairs.append((100, "please contact: AB-4471-9920-X soon"))
    pairs.append((101, "in model ZX-1000-2000-Q there is nothing"))
    out = {r["doc_id"]: r for r in pii.identifiers(frame(pairs)).collect()}
    assert out[100]["spans"] == "id:16:30" and out[100]["n_discovered"] == 1
    assert out[101]["n_discovered"] == 0 and out[5]["n_discovered"] == 0


def near_kept(rows):
    """(id, text) rows that stay: of each component of 0.75-similar texts the one with the smallest id; all without words."""
    rows = sorted(set(rows), key=str)
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    best = {}
    for k, (i, _) in enumerate(rows):
        own = label[k] if sets[k] else -1 - k
        best[own] = min(best.get(own, (math.inf, math.inf)), (math.inf if i is None else i, k))
    return {rows[k] for _, k in best.values()}


def test_pipeline_stages_hold(spark, labelled, tmp_path):
    """Each stage against plain Python on its own input: ids that repeat with other texts, rows without id or text, a leak, copies."""
    import corpus_pipeline

    docs, labels = labelled
    item = " ".join(words(901, 30))
    add = lambda i, text: docs.limit(1).withColumns({"doc_id": F.lit(i).cast("long"), "text": F.lit(text).cast("string"), "source": F.lit("t")})
    near = " ".join(words(4, 60, 300))
    extra = [(1000, f"before {item} after these words"), (1001, near + " more"), (5, "another text of this id"), (None, "a row that has no id at all"), (1002, None), (1003, ""), (1003, ""), (None, near + " more")]
    every = docs.coalesce(1)
    for i, text in extra:
        every = every.union(add(i, text))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {"": [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
        if name != "sharding":
            assert now.columns == every.columns
    toxic = rows["toxicity"]
    assert sum(i is not None and i < 300 and i % 3 == 0 for i, _, _ in toxic) <= 5 and set(extra) <= {(i, t) for i, t, _ in toxic}
    near = rows["near_dedup"]
    assert {(i, t) for i, t, _ in near} == near_kept([(i, t) for i, t, _ in toxic])
    assert {(5, "another text of this id"), (1002, None), (1003, "")} <= {(i, t) for i, t, _ in near} and 1001 not in {i for i, _, _ in near}
    own = shingle_set(item)
    clean = [r for r in near if 100 * len(own & shingle_set(r[1])) < 75 * len(own)]
    assert Counter(rows["decontamination"]) == Counter(clean) and len(clean) == len(near) - 1
    sizes = Counter()
    for _, t, s in clean:
        sizes[s] += len((t or "").split())
    target, taken, copies = brute_targets(sizes), Counter(), Counter(rows["mixing"])
    for (i, t, s), n in copies.items():
        taken[s] += n * len((t or "").split())
        assert n <= 3 * Counter(clean)[i, t, s]
        assert n >= math.floor(target[s] / sizes[s]) * Counter(clean)[i, t, s]
    longest = max(len((t or "").split()) for _, t, _ in clean)
    assert all(abs(taken[s] - target[s]) <= max(0.15 * target[s], longest) for s in sizes)
    assert Counter(rows["sharding"]) == copies
    shard = {}
    for r in now.collect():
        assert 0 <= r["shard"] < 16 and shard.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == copies


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_words_and_texts_hash_alike():
    text = ("Long" * 200 + " b ") * 3
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = textkit.words(data, np.array([0, len(data)]))
    h = textkit.word_hashes(data, s, e)
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0] and len(h) == len(WORD.findall(text.encode()))


def test_clean_takes_items_without_id(spark, frame):
    item, other = " ".join(words(801, 30)), " ".join(words(802, 30))
    docs = frame([(1, f"before {item} after"), (2, f"before {other} after"), (3, " ".join(words(803, 40)))])
    items = spark.createDataFrame([(None, item), (7, other)], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.clean(docs, items).collect()] == [3]
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items).collect()] == [(2, 7)]
