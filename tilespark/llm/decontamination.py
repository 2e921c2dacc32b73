"""Benchmark decontamination: which documents contain which test items.

Items are partitioned by the size of their sets of five-word shingles. All items
of a partition get a bottom MinHash sketch of one length: the smallest
``n - ceil(0.75 n) + 1`` hashes for the partition's largest n. A document that
holds three quarters of an item's shingles can miss too few of them to miss the
whole sketch, so one look-up of each document's shingles among the sketches finds
every candidate; the share of the item's shingles in the document then decides.

Documents are never shuffled. Items go in blocks of a bounded number of shingles, and
blocks in waves of ``WAVE``: a wave is broadcast, the documents are read and shingled
once for all of it, and where more waves follow its result is written before the next
is broadcast. So what is broadcast is bounded whatever the size of the benchmark, and
benchmarks of up to ``WAVE * BLOCK_SHINGLES`` shingles take one pass.

Edge cases: null and empty items or documents match nothing; an item of fewer than
five words is one shingle and matches only a document of just these words;
repeated items count once, repeated documents each; an item without id has no row in
``contained`` but ``clean`` takes out what holds it; an empty table gives an empty
result; other columns are kept by ``clean`` and ignored by ``contained``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import storage, textkit

SHARE_OF_100 = 75
#: Shingles of a block of items, at 8 bytes each.
BLOCK_SHINGLES = 1_000_000
#: Blocks that are broadcast together: about 64 MB of sets, and half of that again for sketches.
WAVE = 8


@dataclass(frozen=True)
class Block:
    """Sketches of some items, and their sets."""

    ids: np.ndarray
    sets: list[np.ndarray]
    keys: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    def plain(self) -> tuple:
        """What is broadcast: arrays only, so that workers can read it without this module."""
        return self.ids, self.sets, self.keys, self.starts, self.owners


def sketch_length(n: int) -> int:
    return n - -(-SHARE_OF_100 * n // 100) + 1


def block_of(items: list[tuple[int, bytes]]) -> Block:
    sets = [np.frombuffer(raw, np.uint64) for _, raw in items]
    partition = [len(s).bit_length() for s in sets]
    largest = {p: max(len(s) for s, q in zip(sets, partition, strict=True) if q == p) for p in set(partition)}
    hashes = [s[: sketch_length(largest[p])] for s, p in zip(sets, partition, strict=True)]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in hashes])
    order = np.argsort(flat, kind="stable")
    keys, starts = np.unique(flat[order], return_index=True)
    return Block(np.array([i for i, _ in items], np.int64), sets, keys, np.append(starts, len(flat)), owner[order])


def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, to, data, offs in textkit.slices(batch.column("text")):
            values, at = textkit.shingle_sets(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, to - first), textkit.binary_column(values, at), pa.array(np.diff(at))], names=["item_id", "shingles", "n"])


def blocks(benchmark: DataFrame, nameless: bool = False) -> Iterator[Block]:
    """The items, in blocks of about ``BLOCK_SHINGLES`` shingles; one block is on the driver at a time. Items without id count if ``nameless``, as -1."""
    sets = (benchmark if nameless else benchmark.where("item_id IS NOT NULL")).select(F.col("item_id").cast("long"), "text").distinct().mapInArrow(item_sets, "item_id long, shingles binary, n long").where("n > 0")
    held, size = [], 0
    for row in storage.staged(sets, "items").toLocalIterator():
        held.append((-1 if row["item_id"] is None else row["item_id"], bytes(row["shingles"])))
        size += row["n"]
        if size >= BLOCK_SHINGLES:
            yield block_of(held)
            held, size = [], 0
    if held:
        yield block_of(held)


def found_in(block: Block, values: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, item's place, shared shingles) for the items that enough of a row's set contains."""
    if not len(block.keys) or not len(values):
        return
    place = np.minimum(np.searchsorted(block.keys, values), len(block.keys) - 1)
    hit = np.flatnonzero(block.keys[place] == values)
    if not len(hit):
        return
    row, place = np.searchsorted(at, hit, "right") - 1, place[hit]
    count = block.starts[place + 1] - block.starts[place]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = block.owners[np.repeat(block.starts[place], count) + nth]
    for code in np.unique(np.repeat(row, count) * len(block.sets) + owner).tolist():
        r, item = divmod(code, len(block.sets))
        own, text = block.sets[item], values[at[r] : at[r + 1]]
        where = np.minimum(np.searchsorted(text, own), len(text) - 1)
        shared = int((text[where] == own).sum())
        if 100 * shared >= SHARE_OF_100 * len(own):
            yield r, item, shared


def waves(found: Iterator[Block]) -> Iterator[tuple[list[Block], bool]]:
    """Some blocks at a time, and whether they are the last."""
    held: list[Block] = []
    for block in found:
        if len(held) == WAVE:
            yield held, False
            held = []
        held.append(block)
    if held:
        yield held, True


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: one row for each document and item that it contains."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_shingles long, shared long"
    out = spark.createDataFrame([], schema)
    for wave, last in waves(blocks(benchmark)):
        sent = spark.sparkContext.broadcast([block.plain() for block in wave])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Block(*parts) for parts in sent.value]
            for batch in batches:
                for first, _, data, offs in textkit.slices(batch.column("text")):
                    values, at = textkit.shingle_sets(data, offs)
                    got = [(first + r, block.ids[i], len(block.sets[i]), s) for block in own for r, i, s in found_in(block, values, at)]
                    if got:
                        row, *rest = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", "item_id", "item_shingles", "shared"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        if not last:
            part = storage.staged(part, "contained")
            sent.unpersist()
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    kept = docs
    for wave, last in waves(blocks(benchmark, nameless=True)):
        sent = docs.sparkSession.sparkContext.broadcast([block.plain() for block in wave])

        def free(sent=sent) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            own = [Block(*parts) for parts in sent.value]

            def keeps(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
                out, (values, at) = np.ones(len(offs) - 1, bool), textkit.shingle_sets(data, offs)
                for block in own:
                    out[[r for r, _, _ in found_in(block, values, at)]] = False
                return out

            return keeps

        kept = textkit.filtered(kept, free)
        if not last:
            kept = storage.staged(kept, "clean")
            sent.unpersist()
    return kept


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH both_tables AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM both_tables
), shingled AS (
  SELECT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i+4], ' ')) END) AS s FROM worded
), sets AS (SELECT DISTINCT kind, id, s FROM shingled
), sizes AS (SELECT id AS item_id, count(*) AS n FROM sets WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared
FROM sets d JOIN sets b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s JOIN sizes ON item_id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n)
"""
