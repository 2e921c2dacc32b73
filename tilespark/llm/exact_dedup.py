"""Exact deduplication by content-defined chunk recipes.

A text is cut where a hash of its last eight bytes says so, each chunk gets an
identifier, and a text becomes the ordered list of identifiers: its recipe. Only
recipes move; texts are read once, where they lie. Identifiers are verified: the
chunk dictionary shows that no two chunks that share one differ in length or in
an independent digest. If two ever did, recipes are built anew from SHA-256.

Edge cases: null counts as empty, and the empty text has the empty recipe, so
nulls and empty texts are one group; equal ids on equal texts (repeated rows)
leave one row; rows without id are kept last; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import storage, textkit

LEAST, MOST, MEAN_BITS = 512, 16384, 11
RECIPE = "doc_id long, row_ long, text_sha256 string, recipe binary, proofs binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("row_", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("proofs", pa.binary())])


def cuts(data: np.ndarray, offs: np.ndarray) -> Iterator[list[int]]:
    """For each row the ends of its chunks. A cut depends on the eight bytes before it and on the cut before."""
    hashed = textkit.mix(textkit.loads(data)[: max(len(data) - 7, 0)].astype(np.uint64))
    able = np.flatnonzero(hashed >> np.uint64(64 - MEAN_BITS) == 0) + 8
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        found, last = [], int(a)
        for c in able[np.searchsorted(able, a + LEAST) : np.searchsorted(able, b)].tolist():
            while c - last > MOST:
                last += MOST
                found.append(last)
            if c - last >= LEAST:
                found.append(c)
                last = c
        while b - last > MOST:
            last += MOST
            found.append(last)
        if b > last:
            found.append(int(b))
        yield found


def recipes(batches: Iterator[pa.RecordBatch], strong: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, places = batch.column("doc_id"), batch.column("row_")
        for first, to, data, offs in textkit.slices(batch.column("text")):
            raw = memoryview(np.ascontiguousarray(data))
            sums, lists, proofs = [], [], []
            for a, ends in zip(offs.tolist(), cuts(data, offs), strict=False):
                whole, start, names, checks = hashlib.sha256(), a, [], []
                for end in ends:
                    chunk = raw[start:end]
                    whole.update(chunk)
                    digest = hashlib.sha256(chunk).digest() if strong else xxhash.xxh3_128_digest(chunk)
                    names.append(digest)
                    checks.append((end - start).to_bytes(4, "big") + hashlib.blake2b(chunk, digest_size=12).digest())
                    start = end
                sums.append(whole.hexdigest())
                lists.append(b"".join(names))
                proofs.append(b"".join(checks))
            yield pa.RecordBatch.from_arrays([ids.slice(first, to - first), places.slice(first, to - first), pa.array(sums, pa.string()), pa.array(lists, pa.binary()), pa.array(proofs, pa.binary())], schema=ARROW)


def doc_recipes(docs: DataFrame, strong: bool = False) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_"), "text")
    return storage.staged(rows.mapInArrow(lambda batches: recipes(batches, strong), RECIPE), "recipes")


def dictionary(table: DataFrame, width: int) -> DataFrame:
    """chunk, uses, proof, same: one row for each identifier; ``same`` says that all chunks behind it agree."""
    places = F.sequence(F.lit(0), (F.octet_length("recipe") / width).cast("int") - 1)
    pairs = table.where(F.octet_length("recipe") > 0).select(F.explode(places).alias("k"), "recipe", "proofs")
    chunks = pairs.select(F.substring("recipe", F.col("k") * width + 1, F.lit(width)).alias("chunk"), F.substring("proofs", F.col("k") * 16 + 1, F.lit(16)).alias("proof"))
    return chunks.groupBy("chunk").agg(F.count("*").alias("uses"), F.min("proof").alias("proof"), (F.min("proof") == F.max("proof")).alias("same"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row for each row of ``docs``."""
    width, table = 16, doc_recipes(docs)
    if dictionary(table, width).where(~F.col("same")).limit(1).count():
        width, table = 32, doc_recipes(docs, strong=True)
    shared = table.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_")).alias("keep_"), F.count("*").alias("group_size")).where("group_size > 1").withColumnRenamed("recipe", "key_")
    shared = storage.staged(shared, "recipe-groups")  # else both sides share an exchange, and a hot group's partition can't be split
    joined = table.join(shared, F.col("recipe") == F.col("key_"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_.row_") == F.col("row_"), F.lit(True)).alias("kept"),
        "text_sha256",
        (F.octet_length("recipe") / width).cast("long").alias("n_chunks"),
    )


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(storage.table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
