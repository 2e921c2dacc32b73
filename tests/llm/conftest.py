import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside, with other contents.
        T.StructField("row_", T.StringType()), T.StructField("key_", T.StringType()), T.StructField("score_", T.DoubleType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()), T.StructField("node", T.StringType()), T.StructField("rate_", T.StringType()), T.StructField("vslot", T.StringType()),
    ]
)


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(pairs, source="s"):
    """Documents from (id, text) pairs, with the clashing columns filled."""
    return [(i, t, "en", f"{source}{(i or 0) % 4}" if i is None or i % 5 else None, len(t or ""), "r", "k", 0.5, "kept", "size", "node", "rate", "slot") for i, t in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


def messy_pairs():
    """Nulls, empty and blank texts, ties, repeated rows, rows without id, near copies, a long text, other scripts."""
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    long_ = words(2, 30_000)
    return [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "One  two\nthree"),
        (9, " ".join(long_)), (10, " ".join(long_[:29_900])), (11, "ça été où ñandú übermäßig " * 20), (11, "ça été où ñandú übermäßig " * 20), (None, " ".join(words(3, 80))), (None, " ".join(words(3, 80))), (None, None),
        (12, "x" * 70_000), (13, "=" * 300), (14, "=" * 300), (15, " ".join(words(4, 55)) + " " + " ".join(base[10:70])), (16, "mail a.b@c.example and +1 (555) 123-4567 now"), (17, "same words here are all five ok"), (18, "same words here are all five ok"),
    ]


@pytest.fixture(scope="session")
def messy(frame):
    return frame(messy_pairs())


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
