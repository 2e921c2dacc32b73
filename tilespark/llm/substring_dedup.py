"""Suffix-array deduplication of byte strings of ``LENGTH`` bytes across documents.

The array holds a sample of all suffixes that misses nothing: every string of 50
bytes picks, by its own bytes alone, one position in it (a modular minimiser), so
equal strings pick alike, and each is decided at the suffix that starts there. A
suffix is kept with the bytes that any of its strings can cover: 50 to the right,
22 to the left.

Sampled splitters range-partition the suffixes by their leading bytes, all 28 that the
strings of a suffix share; so what must meet shares a bucket, and one frequent lead
can still be parted. The sample grows with the number of buckets. Buckets
sort by multikey quicksort, eight bytes at a time, each pass only over what is
still tied. Suffixes with equal surroundings take the smallest document's as a
model; the models that share 28 leading bytes are compared string by string, by a hash
first and by their bytes where that agrees. Tasks
do the same before the exchange, so a passage with many copies crosses it once a
task, and what is decided there crosses only as intervals.

Edge cases: null and empty texts have no bytes; texts under 50 bytes lose none;
rows that repeat an id count as one document, so they remove nothing from each
other (equal texts get equal results); null ids are larger than all others and
equal to each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import storage, textkit

LENGTH = 50
#: Strings pick by 5-byte grams; positions count modulo STEP, so KEY leading bytes of a suffix are in all its strings.
GRAM, STEP = 5, 23
KEY = LENGTH - STEP + 1
SPARE = STEP - 1
GRAMS = LENGTH - GRAM + 1
#: Text whose suffixes a bucket holds on average, and that a task gathers before it sends. Raise both with executor memory.
BUCKET_TEXT, TASK_TEXT = 12 << 20, 12 << 20
BATCH_BYTES = 2 << 20
#: The sample has that many documents at least, and in larger tables about so many leads for each bucket.
SAMPLE_DOCS, LEADS_A_BUCKET = 2_000, 32
#: A document gives one lead for about so many bytes: one in 15 positions is kept, and one in 16 of those is sampled.
LEAD_BYTES, LEAD_STEP = 240, 16
#: The words of a lead, and what counts of the last.
LEAD_WORDS, LEAD_MASK = 4, np.uint64(0xFFFFFFFF00000000)
#: Up to this size the table of removed runs is broadcast; beyond, the texts are shuffled to it.
BROADCAST_BYTES = 48 << 20
#: Up to so many ids (8 bytes each) a list is broadcast.
BROADCAST_IDS = 1_000_000
NO_ID = (1 << 63) - 1

_U = np.uint64
_LOW = (1 << 20) - 1


@dataclass
class Suffixes:
    """Rows: words (n, 9) of big-endian bytes, 50 from the suffix on, then 22 before it, nearest first; how many of the last 22 either way exist; document and position."""

    words: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    nth: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, rows: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f)[rows] for f in ("words", "left", "right", "doc", "nth", "at")))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("words", "left", "right", "doc", "nth", "at")))


def picked(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that some string of 50 bytes picks, and their rows: at the smallest of its grams, the last one of equals, modulo STEP."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (textkit.loads(data)[: n - GRAM + 1] & _U((1 << (8 * GRAM)) - 1)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    place = np.arange(len(h), dtype=np.uint64)
    least = (h & ~_U(_LOW)) | (_U(_LOW) - place)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
    first = np.arange(len(least))
    gram = _LOW - (least & _U(_LOW)).astype(np.int64)
    at = first + (gram - first) % STEP
    row = np.searchsorted(offs, first, "right") - 1
    at = np.unique(at[first + LENGTH <= offs[row + 1]])
    return at, np.searchsorted(offs, at, "right") - 1


def surroundings(data: np.ndarray, offs: np.ndarray, at: np.ndarray, row: np.ndarray, doc: np.ndarray, nth: np.ndarray) -> Suffixes:
    padded = np.concatenate([np.zeros(SPARE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.as_strided(padded, (len(data), SPARE + LENGTH), (1, 1))[at]
    left, right = np.minimum(at - offs[row], SPARE), np.minimum(offs[row + 1] - at - KEY, SPARE)
    place = np.arange(SPARE)
    raw = np.empty((len(at), LENGTH + SPARE), np.uint8)
    raw[:, :LENGTH] = around[:, SPARE:]
    raw[:, LENGTH:] = around[:, SPARE - 1 :: -1]
    cut = np.flatnonzero(right < SPARE)
    raw[cut, KEY:LENGTH] *= place < right[cut, None]
    cut = np.flatnonzero(left < SPARE)
    raw[cut, LENGTH:] *= place < left[cut, None]
    return Suffixes(raw.view(">u8").astype(np.uint64), left.astype(np.int8), right.astype(np.int8), doc[row], nth[row], at - offs[row])


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, and where runs of rows that agree in all words start. Each word sorts only rows that tie so far."""
    order = np.argsort(words[0], kind="stable")
    first = words[0][order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for word in words[1:]:
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        run, value = np.cumsum(new)[tied], word[order[tied]]
        sub = np.lexsort((value, run))
        order[tied] = order[tied][sub]
        run, value = run[sub], value[sub]
        change = np.ones(len(tied), bool)
        change[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
        new[tied] = change
    return order, new


def sorted_by_surroundings(s: Suffixes) -> tuple[Suffixes, np.ndarray]:
    """In order of surroundings, then document; and where runs of equal surroundings start."""
    sides = (s.left.astype(np.int64) * 64 + s.right).astype(np.uint64)
    if not len(s):
        return s, np.zeros(0, bool)
    order, new = multikey_order([*(s.words[:, j] for j in range(s.words.shape[1])), sides])
    run = np.cumsum(new)
    sub = np.lexsort((s.doc[order], run))
    return s.take(order[sub]), new


def repeated(s: Suffixes, new: np.ndarray) -> np.ndarray:
    """Rows whose surroundings a smaller document has too."""
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return s.doc != s.doc[start]


def whole_intervals(s: Suffixes, rows: np.ndarray) -> np.ndarray:
    """(doc, nth, start, end): all strings of the rows are covered."""
    low, high = SPARE - s.right[rows].astype(np.int64), s.left[rows].astype(np.int64)
    return np.column_stack([s.doc[rows], s.nth[rows], s.at[rows] - high, s.at[rows] - low + LENGTH])


def partial_intervals(s: Suffixes, new: np.ndarray) -> np.ndarray:
    """Of rows in order, without rows that are repeated: what strings a smaller document has too, compared offset by offset."""
    none = np.zeros((0, 4), np.int64)
    if not len(s):
        return none
    same = np.zeros(len(s), bool)
    same[1:] = (s.words[1:, :3] == s.words[:-1, :3]).all(axis=1) & (s.words[1:, 3] >> _U(32) == s.words[:-1, 3] >> _U(32))
    key = np.cumsum(~same)
    size = np.bincount(key)
    low, high = np.full(len(size), NO_ID), np.full(len(size), -NO_ID)
    np.minimum.at(low, key, s.doc)
    np.maximum.at(high, key, s.doc)
    rows = np.flatnonzero((low < high)[key])
    if not len(rows):
        return none
    parts, at = [], 0
    while at < len(rows):
        to = min(at + 200_000, len(rows))
        while to < len(rows) and key[rows[to]] == key[rows[to - 1]]:
            to += 1
        parts.append(compared(s.take(rows[at:to]), key[rows[at:to]]))
        at = to
    return np.concatenate(parts)


def compared(s: Suffixes, key: np.ndarray) -> np.ndarray:
    raw = s.words.astype(">u8").view(np.uint8).reshape(len(s), LENGTH + SPARE)

    def running(part: np.ndarray, salt: int) -> np.ndarray:
        out = np.zeros((part.shape[1] + 1, len(s)), np.uint64)
        for j in range(part.shape[1]):
            out[j + 1] = textkit.mix(out[j] * _U(salt) + part[:, j] + _U(1))
        return out

    right, left = running(raw[:, KEY:LENGTH], 0x2545F4914F6CDD1D), running(raw[:, LENGTH:], 0x9FB21C651E98DF25)
    base = textkit.mix(key.astype(np.uint64))
    low, high = np.full(len(s), SPARE + 1), np.full(len(s), -1)
    for back in range(SPARE + 1):
        rows = np.flatnonzero((back <= s.left) & (SPARE - back <= s.right))
        value = base[rows] ^ (left[back, rows] * _U(3) + right[SPARE - back, rows])
        order = np.lexsort((s.doc[rows], value))
        value, doc = value[order], s.doc[rows][order]
        new = np.ones(len(rows), bool)
        new[1:] = value[1:] != value[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        later = np.flatnonzero(doc != doc[start]) if len(rows) else rows
        hit, model = rows[order[later]], rows[order[start[later]]]
        same = (key[hit] == key[model]) & (raw[hit, KEY : LENGTH - back] == raw[model, KEY : LENGTH - back]).all(axis=1) & (raw[hit, LENGTH : LENGTH + back] == raw[model, LENGTH : LENGTH + back]).all(axis=1)
        if not same.all():
            # Two strings with one hash: those groups are told apart by their bytes.
            mixed = rows[order[np.isin(start, start[later[~same]])]]
            hit = np.concatenate([np.setdiff1d(hit, mixed), repeated_bytes(s.doc[mixed], [(key[r], raw[r, KEY : LENGTH - back].tobytes(), raw[r, LENGTH : LENGTH + back].tobytes()) for r in mixed], mixed)])
        low[hit], high[hit] = np.minimum(low[hit], back), back
    hit = np.flatnonzero(high >= 0)
    return np.column_stack([s.doc[hit], s.nth[hit], s.at[hit] - high[hit], s.at[hit] - low[hit] + LENGTH])


def repeated_bytes(doc: np.ndarray, texts: list[tuple], rows: np.ndarray) -> np.ndarray:
    """The rows whose string a smaller document has too."""
    first: dict[tuple, int] = {}
    for d, t in zip(doc.tolist(), texts, strict=True):
        first[t] = min(first.get(t, d), d)
    return rows[[d > first[t] for d, t in zip(doc.tolist(), texts, strict=True)]]


def pressed(*columns: np.ndarray) -> bytes:
    """Columns of one length, bytes of like weight together, compressed."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T if c.ndim == 1 else c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpressed(blob: bytes, rows: int, kinds: list) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for kind in kinds:
        if isinstance(kind, int):
            out.append(raw[at : at + rows * kind].reshape(rows, kind))
            at += rows * kind
        else:
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).view(kind).ravel())
            at += rows * width
    return out


def suffix_blob(s: Suffixes) -> bytes:
    raw = s.words.astype(">u8").view(np.uint8).reshape(len(s), LENGTH + SPARE)
    return pressed(raw[:, :LENGTH], raw[:, LENGTH:], s.left, s.right, s.doc, s.nth, s.at)


def suffixes_of(blob: bytes, rows: int) -> Suffixes:
    right, left, *rest = unpressed(blob, rows, [LENGTH, SPARE, np.int8, np.int8, np.int64, np.int64, np.int64])
    raw = np.hstack([right, left])
    return Suffixes(raw.view(">u8").astype(np.uint64), *rest)


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (textkit.mix(doc.astype(np.uint64)) % _U(buckets)).astype(np.int64)


def boundaries(words: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where each bucket starts and the last ends among rows in order: a row belongs to as many splitters as aren't above its lead."""
    out = np.zeros(len(splitters) + 2, np.int64)
    out[-1] = len(words)
    low, high = np.searchsorted(words[:, 0], splitters[:, 0], "left"), np.searchsorted(words[:, 0], splitters[:, 0], "right")
    for b, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for j in range(1, LEAD_WORDS):
            if x == y:
                break
            column = words[x:y, j] if j < LEAD_WORDS - 1 else words[x:y, j] & LEAD_MASK
            x, y = x + int(np.searchsorted(column, splitters[b, j], "left")), x + int(np.searchsorted(column, splitters[b, j], "right"))
        out[b + 1] = x
    return out


SENT = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("suffixes", pa.binary()), ("m", pa.int64()), ("runs", pa.binary())])


def sent(parts: list[Suffixes], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task sends to each bucket: suffixes, and intervals that are decided already. Batches are small, as both sides hold them whole."""
    buckets = len(splitters) + 1
    s = Suffixes.joined(parts)
    parts.clear()  # what is held twice counts twice
    s, new = sorted_by_surroundings(s)
    done = repeated(s, new)
    runs = whole_intervals(s, np.flatnonzero(done))
    s = s.take(np.flatnonzero(~done))
    edges = boundaries(s.words, splitters)
    own = doc_bucket(runs[:, 0], buckets)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0], own))]
    run_edges = np.searchsorted(np.sort(own), np.arange(buckets + 1))
    rows: list[tuple] = []
    weight = 0
    for b in range(buckets):
        part, got = s.take(np.arange(edges[b], edges[b + 1])), runs[run_edges[b] : run_edges[b + 1]]
        if len(part) or len(got):
            rows.append((b, len(part), suffix_blob(part), len(got), pressed(*got.T)))
            weight += len(rows[-1][2]) + len(rows[-1][4])
        if weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Suffixes]]:
    """Bytes of text and suffixes, slice by slice."""
    for batch in batches:
        doc, nth = batch.column("id_").to_numpy(), batch.column("nth_").to_numpy()
        for first, to, data, offs in textkit.slices(batch.column("text"), 1 << 19):
            for size, part in pieces(data, offs):
                at, row = picked(data[part[0] : part[1]], offs_within(offs, part))
                yield size, surroundings_within(data, offs, part, at, doc[first:to], nth[first:to])


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """Stretches of under 2**20 bytes that overlap so that each string is whole in one of them."""
    at, most = 0, 1 << 19
    while True:
        to = min(at + most, len(data))
        yield to - at, (at, to)
        if to == len(data):
            break
        at = to - LENGTH + 1


def offs_within(offs: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return np.clip(offs, *part) - part[0]


def surroundings_within(data: np.ndarray, offs: np.ndarray, part: tuple[int, int], at: np.ndarray, doc: np.ndarray, nth: np.ndarray) -> Suffixes:
    place = at + part[0]
    return surroundings(data, offs, place, np.searchsorted(offs, place, "right") - 1, doc, nth)


def gathered(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for n, part in read(batches):
        held.append(part)
        size += n
        if size >= TASK_TEXT:
            yield from sent(held, splitters)
            held, size = [], 0
    if held:
        yield from sent(held, splitters)


RUNS = pa.schema([("bucket", pa.int32()), ("m", pa.int64()), ("runs", pa.binary())])


def decided(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One bucket: its suffixes sorted and compared, to intervals for the buckets of their documents."""
    held, runs = [], []
    for batch in batches:
        for n, blob, m, run in zip(*(batch.column(c) for c in ("n", "suffixes", "m", "runs")), strict=True):
            if n.as_py():
                held.append(suffixes_of(blob.as_py(), n.as_py()))
            if m.as_py():
                runs.append(np.column_stack(unpressed(run.as_py(), m.as_py(), [np.int64] * 4)))
    if held:
        s = Suffixes.joined(held)
        held.clear()
        s, new = sorted_by_surroundings(s)
        done = repeated(s, new)
        runs.append(whole_intervals(s, np.flatnonzero(done)))
        runs.append(partial_intervals(s.take(np.flatnonzero(~done)), new))
    if not runs:
        return
    every = np.concatenate(runs)
    own = doc_bucket(every[:, 0], buckets)
    order = np.lexsort((every[:, 2], every[:, 1], every[:, 0], own))
    every, edges = every[order], np.searchsorted(own[order], np.arange(buckets + 1))
    rows = [(b, int(edges[b + 1] - edges[b]), pressed(*every[edges[b] : edges[b + 1]].T)) for b in range(buckets) if edges[b + 1] > edges[b]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUNS, strict=True)], schema=RUNS)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals of a bucket of documents, joined where they meet: id_, nth_, runs (pairs of int64)."""
    parts = [np.column_stack(unpressed(r["runs"], r["m"], [np.int64] * 4)) for batch in batches for r in batch.to_pylist()]
    if not parts:
        return
    every = np.concatenate(parts)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new_doc = np.ones(len(every), bool)
    new_doc[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    group = np.cumsum(new_doc) - 1
    # Ends never fall within a document: a shift by group keeps documents apart in one running maximum.
    span = int(every[:, 3].max()) + 1
    reach = np.maximum.accumulate(every[:, 3] + group * span)
    new = np.ones(len(every), bool)
    new[1:] = every[1:, 2] + group[1:] * span > reach[:-1]
    starts = np.flatnonzero(new)
    ends = reach[np.append(starts[1:], len(every)) - 1] - group[starts] * span
    pairs = np.column_stack([every[starts, 2], ends]).astype(np.int64)
    doc_first = np.flatnonzero(new_doc[starts])
    yield pa.RecordBatch.from_arrays([pa.array(every[starts[doc_first], 0]), pa.array(every[starts[doc_first], 1]), textkit.binary_column(pairs.ravel(), np.append(doc_first, len(starts)) * 2)], names=["id_", "nth_", "runs"])


def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        for first, to, data, offs in textkit.slices(batch.column("text")):
            size, gone, count, sums = np.diff(offs), [], [], []
            for k in range(to - first):
                text, cut = memoryview(np.ascontiguousarray(data[offs[k] : offs[k + 1]])), runs[first + k].as_py()
                pairs = np.frombuffer(cut, np.int64).reshape(-1, 2) if cut else np.zeros((0, 2), np.int64)
                left, at = hashlib.sha256(), 0
                for a, b in pairs.tolist():
                    left.update(text[at:a])
                    at = b
                left.update(text[at:])
                gone.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                count.append(len(pairs))
                sums.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, to - first), pa.array(size), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, id_, nth_, text: ``nth_`` tells apart different texts of one id, by a hash; it is 0 for all whose id is theirs alone."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_"), "text")
    shared = storage.staged(rows.groupBy("id_").agg(F.count("*").alias("n")).where("n > 1").select("id_", F.lit(True).alias("shared_")), "shared-ids")
    count = shared.count()
    if not count:
        return rows.withColumn("nth_", F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(shared) if count <= BROADCAST_IDS else shared, "id_", "left")
    return marked.select("doc_id", "id_", F.when(F.col("shared_"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("nth_"), "text")


def sample_splitters(rows: DataFrame, count: int, size: int, buckets: int) -> np.ndarray:
    """Leads that part the suffixes of a sample of documents evenly. Only balance depends on the sample."""
    every = max(1, min(count // SAMPLE_DOCS, size // (LEAD_BYTES * LEADS_A_BUCKET * buckets)))
    names = [f"w{j}" for j in range(LEAD_WORDS)]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in read(batches):
            some = lead_words(s.words[::LEAD_STEP])
            yield pa.RecordBatch.from_arrays([pa.array(some[:, j].copy().view(np.int64)) for j in range(LEAD_WORDS)], names=names)

    found = rows.where(F.pmod(F.xxhash64("id_"), F.lit(every)) == 0).select("id_", "nth_", "text").mapInArrow(leads, ", ".join(f"{n} long" for n in names)).toArrow()
    return quantiles(np.column_stack([found.column(n).to_numpy().view(np.uint64) for n in names]), buckets)


def lead_words(words: np.ndarray) -> np.ndarray:
    out = words[:, :LEAD_WORDS].copy()
    out[:, -1] &= LEAD_MASK
    return out


def quantiles(leads: np.ndarray, buckets: int) -> np.ndarray:
    if buckets < 2 or not len(leads):
        return np.zeros((0, LEAD_WORDS), np.uint64)
    leads = leads[np.lexsort(leads.T[::-1])]
    return np.unique(leads[np.arange(1, buckets) * len(leads) // buckets], axis=0)


def removed_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, id_, nth_, runs): the maximal runs of bytes to remove, for documents that have any."""
    spark, rows = docs.sparkSession, numbered(docs)
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(-(-size // BUCKET_TEXT), int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = sample_splitters(rows, count, size, buckets)
    buckets = len(splitters) + 1
    exchanged = rows.select("id_", "nth_", "text").mapInArrow(lambda b: gathered(b, splitters), "bucket int, n long, suffixes binary, m long, runs binary")
    runs = exchanged.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda b: decided(b, buckets), "bucket int, m long, runs binary")
    out = runs.repartitionById(buckets, F.col("bucket")).mapInArrow(merged, "id_ long, nth_ long, runs binary")
    return rows, storage.staged(out, "removed-runs")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    rows, runs = removed_runs(docs)
    size = runs.agg(F.coalesce(F.sum(F.octet_length("runs") + 16), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(runs) if size <= BROADCAST_BYTES else runs, ["id_", "nth_"], "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(stripped, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(storage.table(spark, sf_dir, "documents"))
