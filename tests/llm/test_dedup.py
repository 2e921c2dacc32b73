"""Exact, near, substring and passage deduplication against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import messy_pairs, words
from tilespark.llm import components, exact_dedup, near_dedup, passages, substring_dedup, textkit


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_words_and_shingles_match_plain_python():
    texts = [t for _, t in messy_pairs()]
    data = "".join(t or "" for t in texts).encode()
    offs = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    _, at = textkit.shingle_sets(np.frombuffer(data, np.uint8), offs)
    assert np.diff(at).tolist() == [len(shingle_set(t)) for t in texts]


def test_exact_groups(messy):
    out = [r.asDict() for r in exact_dedup.groups(messy).collect()]
    assert len(out) == len(messy_pairs())
    sizes = defaultdict(int)
    for _, t in messy_pairs():
        sizes[t or ""] += 1
    by_text = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in messy_pairs()}
    for r in out:
        assert r["group_size"] == sizes[by_text[r["text_sha256"]]]
    assert sum(r["kept"] for r in out) == len(sizes)
    kept = {r["doc_id"]: r["keep_id"] for r in out if r["doc_id"] is not None}
    assert kept[1] == 3 and kept[4] == 5 and kept[13] == 14 and kept[11] == 11 and kept[2] == 2


def test_exact_strong_identifiers_agree(messy):
    plain, strong = exact_dedup.doc_recipes(messy), exact_dedup.doc_recipes(messy, strong=True)
    assert plain.select("recipe").distinct().count() == strong.select("recipe").distinct().count()
    assert exact_dedup.dictionary(plain, 16).where("NOT same").count() == 0


def test_chunks_cover_text_and_follow_content():
    rng = np.random.default_rng(5)
    body = rng.integers(0, 256, 100_000, dtype=np.uint8)
    first = next(exact_dedup.cuts(body, np.array([0, len(body)])))
    moved = np.concatenate([rng.integers(0, 256, 37, dtype=np.uint8), body])
    second = next(exact_dedup.cuts(moved, np.array([0, len(moved)])))
    assert first[-1] == len(body) and max(np.diff([0, *first])) <= exact_dedup.MOST
    assert len({e + 37 for e in first} & set(second)) > 0.8 * len(first)


def test_near_components(messy):
    out = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.membership(messy).collect()}
    by_id = {k[0]: v for k, v in out.items() if k[0] is not None}
    assert by_id[2]["component_id"] == 1 and by_id[3]["component_id"] == 1 and by_id[10]["component_id"] == 9
    assert by_id[8]["component_id"] == 7 and by_id[18]["component_id"] == 17
    for i in (4, 5, 6):
        assert by_id[i]["component_id"] == i and by_id[i]["kept"] and by_id[i]["n_shingles"] == 0
    assert by_id[15]["component_id"] == 15
    kept = near_dedup.deduped(messy)
    assert kept.columns == messy.columns
    ids = sorted(r[0] for r in kept.select("doc_id").where("doc_id IS NOT NULL").collect())
    assert ids == [1, 4, 5, 6, 7, 9, 11, 12, 13, 15, 16, 17]
    assert kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_near_links_against_all_pairs(frame, seed):
    rng = np.random.default_rng(seed)
    pairs, nth = [], 0
    for g in range(12):
        base = words(seed * 100 + g, int(rng.integers(8, 200)))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                copy[int(rng.integers(len(copy)))] = f"new{nth}{rng.integers(1000)}"
            pairs.append((nth, " ".join(copy)))
            nth += 1
    sets = {i: shingle_set(t) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.membership(frame(pairs)).collect()}
    assert out == {i: root(i) for i in sets}


def test_signatures_meet_within_distance():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    for _ in range(200):
        other = one.copy()
        places = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        other[places] ^= 1
        chunks = (one != other).reshape(near_dedup.CHUNKS, near_dedup.WIDTH).sum(axis=1)
        assert chunks.min() <= 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    out = {r["node"]: r["label"] for r in components.labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[i] == 100 for i in range(100, 140)) and 200 not in out


def brute_substring(pairs):
    """(bytes, removed, spans, sha) by row: 50-byte strings that a smaller id has, null ids last."""
    order = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, t in pairs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, order(i)), order(i))
    out = []
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_substring_against_brute_force(messy):
    pairs = [p for p in messy_pairs() if len(p[1] or "") < 100_000]
    got = [tuple(r) for r in substring_dedup.digest(messy).where("n_bytes < 100000").collect()]
    assert sorted(got, key=str) == brute_substring(pairs)


def test_substring_small_texts(frame):
    rng = np.random.default_rng(11)
    pairs = []
    for i in range(60):
        parts = [" ".join(words(int(rng.integers(12)), 20)) for _ in range(int(rng.integers(1, 4)))] + ["é" * int(rng.integers(0, 60)), "ab" * int(rng.integers(0, 40))]
        rng.shuffle(parts)
        pairs.append((i if i % 11 else 11 * (i // 22), "".join(parts)))
    got = sorted((tuple(r) for r in substring_dedup.digest(frame(pairs)).collect()), key=str)
    assert got == brute_substring(pairs)


def test_substring_branches_agree(frame, monkeypatch):
    """Many buckets, shuffled lists instead of broadcast ones, and a hash that is the same for all strings."""
    rng = np.random.default_rng(13)
    pairs = [(i if i % 7 else 3, " ".join(words(int(rng.integers(6)), 30) + words(100 + i, 8) + words(int(rng.integers(6)), 30))) for i in range(40)] + [(50, None), (51, "")]
    expected = brute_substring(pairs)
    result = lambda: sorted((tuple(r) for r in substring_dedup.digest(frame(pairs)).collect()), key=str)
    monkeypatch.setattr(substring_dedup, "BUCKET_TEXT", 200)
    monkeypatch.setattr(substring_dedup, "TASK_TEXT", 3000)
    assert result() == expected
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", 0)
    assert result() == expected


def test_strings_with_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(14)
    lead = rng.integers(97, 123, 28, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 99, 22, dtype=np.uint8), lead, rng.integers(97, 99, 22, dtype=np.uint8)]) for _ in range(60)]
    data, offs = np.concatenate(texts), np.arange(61) * 72
    s = substring_dedup.surroundings(data, offs, np.arange(60) * 72 + 22, np.arange(60), np.arange(60), np.zeros(60, np.int64))
    plain = substring_dedup.compared(s, np.zeros(60, np.int64))
    monkeypatch.setattr(textkit, "mix", lambda h: h * np.uint64(0))
    assert (substring_dedup.compared(s, np.zeros(60, np.int64)) == plain).all()


def test_boundaries_follow_the_whole_lead():
    rng = np.random.default_rng(15)
    words_ = rng.integers(0, 3, (500, 9)).astype(np.uint64) << np.uint64(31)
    words_ = words_[np.lexsort(substring_dedup.lead_words(words_).T[::-1])]
    splitters = substring_dedup.quantiles(substring_dedup.lead_words(words_[::3]), 40)
    edges = substring_dedup.boundaries(words_, splitters)
    own = [tuple(r) for r in substring_dedup.lead_words(words_).tolist()]
    expected = [sum(tuple(s) <= r for s in splitters.tolist()) for r in own]
    assert len(splitters) > 10 and np.repeat(np.arange(len(splitters) + 1), np.diff(edges)).tolist() == expected


def test_every_string_picks_by_its_own_bytes():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 101, 400, dtype=np.uint8)
    whole, _ = substring_dedup.picked(body, np.array([0, len(body)]))
    for p in range(0, 350, 7):
        own, _ = substring_dedup.picked(body[p : p + 50].copy(), np.array([0, 50]))
        assert own[0] + p in whole and own[0] <= substring_dedup.SPARE


def test_passages_cover_exact_repeats(messy, frame):
    out = passages.found(messy).collect()
    assert {r["doc_id"] for r in out} >= {2, 3, 10, 15, 14} - {14}
    shared = words(77, 60)
    pairs = [(i, " ".join([*words(i + 1000, 100 + i), *shared, *words(i + 2000, 50)])) for i in range(30)] + [(100 + i, " ".join(words(i + 5000, 300))) for i in range(20)]
    rows = passages.found(frame(pairs)).collect()
    cover = defaultdict(set)
    for r in rows:
        cover[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        cover[r["other_id"]] |= set(range(r["other_start"], r["other_end"]))
        assert r["similarity"] >= 0.75
    for i in range(30):
        assert set(range(100 + i, 160 + i)) <= cover[i]
    assert not any(i >= 100 for i in cover)


def test_compact_windows_are_maximal():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    at = np.array([0, 120, 300])
    row, c, low, high = passages.windows(s, at, 2)
    value = textkit.mix(s * passages._SALTS[2])
    expected = []
    for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        for i in range(a, b):
            x = i
            while x > a and value[x - 1] > value[i]:
                x -= 1
            y = i
            while y + 1 < b and value[y + 1] > value[i]:
                y += 1
            if y - x + 1 >= passages.TOKENS:
                expected.append((r, i - a, x - a, y - a))
    assert sorted(zip(row.tolist(), c.tolist(), low.tolist(), high.tolist(), strict=True)) == sorted(expected)


def test_empty_tables(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert near_dedup.membership(empty).count() == 0
    assert near_dedup.deduped(empty).columns == empty.columns
    assert substring_dedup.digest(empty).count() == 0
    assert passages.found(empty).count() == 0


def test_crowded_group_against_all_pairs(frame, monkeypatch):
    """Hundreds of variants of one text, most pairs not similar enough: blocks are compared as a whole."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "PAIRS_A_NODE", 0.5)
    monkeypatch.setattr(near_dedup, "SEEKERS", 5)
    rng = np.random.default_rng(9)
    base, pairs = words(500, 120), []
    for i in range(260):
        copy = list(base)
        for _ in range(int(rng.integers(0, 9))):
            copy[int(rng.integers(len(copy)))] = f"v{i}x{rng.integers(99)}"
        pairs.append((i, " ".join(copy)))
    sets = [shingle_set(t) for _, t in pairs]
    label = list(range(260))
    changed = True
    near = [(i, j) for i in range(260) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.membership(frame(pairs)).collect()}
    assert out == dict(enumerate(label)) and len(set(label)) > 3


def test_shared_counts_match_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    got = near_dedup.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def passage_rows(b, a):
    """What ``passages.aligned`` finds, in tokens, of two texts given as words."""
    cut = [passages.tokens(np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(" ".join(t))]))[0] for t in (b, a)]
    return passages.aligned(cut[0], cut[1], np.argsort(cut[1], kind="stable"))


@pytest.mark.parametrize("order", ["before", "after", "both"])
def test_passage_with_a_line_repeated_in_the_other_text(order):
    line, one, two = words(1, 20), words(2, 30), words(3, 30)
    passage = [*one, *line, *two]
    earlier = [*(line if order != "after" else []), *words(4, 40), *passage, *words(5, 40), *(line if order != "before" else [])]
    rows = passage_rows([*words(6, 25), *passage, *words(7, 25)], earlier)
    start = earlier.index(one[0])
    assert rows == [(25, 101, start, start + 76, 1.0)]


def test_passage_that_begins_with_a_repeated_line():
    line, rest = words(11, 20), words(12, 34)
    rows = passage_rows([*words(13, 30), *line, *rest], [*line, *words(14, 30), *line, *rest])
    assert rows == [(30, 80, 50, 100, 1.0)]


def test_runs_match_all_places():
    rng = np.random.default_rng(12)
    b, a = rng.integers(0, 6, 70).astype(np.uint64), rng.integers(0, 7, 50).astype(np.uint64)
    expected = set()
    for x in range(70):
        for y in range(50):
            if b[x] == a[y] and (not x or not y or b[x - 1] != a[y - 1]):
                n = 1
                while x + n < 70 and y + n < 50 and b[x + n] == a[y + n]:
                    n += 1
                expected.add((x, y, n))
    assert set(zip(*(v.tolist() for v in passages.runs(b, a, np.argsort(a, kind="stable"))), strict=True)) == expected


@pytest.mark.parametrize(("cut", "put"), [(9, 9), (0, 10), (19, 0), (9, 0)])
def test_passage_with_a_gap_in_it(cut, put):
    """45 equal words, some replaced, inserted or left out, 45 equal words: one passage of similarity 0.75 or more."""
    left, right = words(21, 45), words(22, 45)
    earlier = [*words(23, 40), *left, *words(24, cut), *right, *words(25, 40)]
    rows = passage_rows([*words(26, 30), *left, *words(27, put), *right, *words(28, 30)], earlier)
    shared = 82
    union = 82 + (cut + 4) + (put + 4) if cut + put else 86
    assert [r[:4] for r in rows] == [(30, 30 + 86 + put, 40, 40 + 86 + cut)] and rows[0][4] == pytest.approx(shared / union)


@pytest.mark.parametrize("seed", range(4))
def test_passages_cover_all_similar_stretches(seed):
    """Against all pairs of a first and a last equal stretch."""
    rng = np.random.default_rng(seed)
    b, a, at_b, at_a = [], [], 0, 0
    places = []
    for g in range(14):
        n, x, y = (int(v) for v in (rng.integers(1, 60), rng.integers(0, 25) * (g > 0), rng.integers(0, 25)))
        same = np.arange(n) + 10_000 * g
        b, a = [*b, *(same[0] + 1_000 + np.arange(x)), *same], [*a, *(same[0] + 5_000 + np.arange(y)), *same]
        places.append((len(b) - n, len(b), len(a) - n, len(a)))
    b, a = np.array(b, np.uint64), np.array(a, np.uint64)
    rows = passages.aligned(b, a, np.argsort(a, kind="stable"))
    assert all(r[4] >= 0.75 and r[4] == passages.similarity(b[r[0] : r[1]], a[r[2] : r[3]]) for r in rows)
    covered = {x for r in rows for x in range(r[0], r[1])}
    for x in range(14):
        for y in range(x, 14):
            i, j, p, q = places[x][0], places[y][1], places[x][2], places[y][3]
            if j - i >= passages.TOKENS and 100 * passages.similarity(b[i:j], a[p:q]) >= 75:
                assert set(range(i, j)) <= covered


@pytest.mark.parametrize("edits", [0, 1])
def test_passages_around_a_common_line(frame, edits):
    """A line of 40 words in 160 texts; pairs of them share 60 words or so around it, which is compared with all pairs."""
    rng = np.random.default_rng(edits)
    line, texts = words(99, 40), {}
    for g in range(40):
        left, right = words(1000 + g, 12), words(2000 + g, 12)
        for half in (0, 1):
            passage = [*left, *line, *right]
            for e in range(half * edits):
                passage[int(rng.choice([*range(12), *range(52, 64)]))] = f"new{g}x{e}"
            texts[g + 1000 * half] = [*words(3000 + g + 100 * half, 30), *passage, *words(4000 + g + 100 * half, 30)]
    texts |= {200 + g: [*words(5000 + g, 40), *line, *words(6000 + g, 40)] for g in range(80)}
    sets = {i: textkit.shingle_sets(np.frombuffer(" ".join(t[30:94]).encode(), np.uint8), np.array([0, len(" ".join(t[30:94]))]))[0] for i, t in texts.items() if i < 200 or i >= 1000}
    ids = sorted(sets)
    near = {(a, b) for a in ids for b in ids if a < b and b >= 1000 and a + 1000 == b and passages.similarity(sets[a], sets[b]) >= 0.75}
    out = passages.found(frame([(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert len(near) >= 30 and {(r["other_id"], r["doc_id"]) for r in out} >= near
    if not edits:
        assert {r["doc_id"] for r in out if r["start_word"] <= 30 and r["end_word"] >= 94} == {b for _, b in near}
