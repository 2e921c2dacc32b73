"""What runs only beyond a limit gives what runs below it."""

from pyspark.sql import functions as F

from tests.llm.conftest import messy_pairs, words
from tilespark.llm import exact_dedup, mixing, passages, pii, storage, toxicity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_chunks_that_share_an_identifier_get_stronger_ones(messy, monkeypatch):
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "n_chunks"]
    plain = rows(exact_dedup.groups(messy).select(*columns))
    real = exact_dedup.dictionary
    monkeypatch.setattr(exact_dedup, "dictionary", lambda table, width: real(table, width).withColumn("same", F.lit(False)))
    assert rows(exact_dedup.groups(messy).select(*columns)) == plain and len(plain) == len(messy_pairs())


def test_mixing_with_shuffled_rates(messy, monkeypatch):
    plain, mixed = rows(mixing.plan(messy)), rows(mixing.mixed(messy))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows(mixing.plan(messy)) == plain and rows(mixing.mixed(messy)) == mixed


def test_passages_with_shuffled_lists(frame, monkeypatch):
    shared = words(1, 70)
    pairs = [(i, " ".join([*words(10 + i, 20), *shared, *words(50 + i, 20)])) for i in range(20)] + [(30, " ".join(shared)), (31, " ".join(shared)), (30, None)]
    plain = rows(passages.found(frame(pairs)))
    monkeypatch.setattr(passages, "BROADCAST_IDS", 0)
    monkeypatch.setattr(passages, "BUCKET_TEXT", 500)
    monkeypatch.setattr(passages, "TASK_TEXT", 1000)
    assert rows(passages.found(frame(pairs))) == plain and len({r[0] for r in plain}) >= 20


def test_texts_under_one_id_are_learned_alike_in_any_order(spark, frame):
    pairs = [(i % 30, " ".join([*words(i, 20, 100), *(["foul"] if i % 30 % 2 else [])])) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    one = rows(toxicity.scores(frame(pairs), labels))
    assert rows(toxicity.scores(frame(pairs[::-1]).repartition(3), labels)) == one


def test_temporaries_go_with_their_last_reader(spark, frame):
    before = storage.mark()
    kept = pii.identifiers(frame([(1, "write to a@b.example now")])).collect()
    assert kept and storage.mark() - before == 3  # the scan, the tokens, and what was found
    storage.clear(spark)
    assert storage.mark() == 0
