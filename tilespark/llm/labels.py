"""Labelled rows for the classifiers: folds by a checksum of the id, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (a null id as empty text), modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id, label, weight: at most ``per_class`` rows of each label, the first by a hash of the id, none held out.

    ``weight`` makes up for what a class has beyond the bound. A document with several labels gets the largest.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        parts.append(part.withColumn("weight", F.lit(max(1.0, n / per_class))))
    return parts[0].unionByName(parts[1])
