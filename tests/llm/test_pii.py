"""Discovery of unseen identifiers: precision, recall, contexts, and long texts."""

import random
import time

from tests.llm.conftest import rows_of, words
from tilespark.llm import pii


def code(rng):
    return f"{rng.choice('ABCDEFGH')}{rng.choice('KLMNP')}-{rng.randrange(1000, 9999)}-{rng.randrange(1000, 9999)}"


def discovered(docs):
    """(doc_id, start, end) of spans of kind id."""
    out = set()
    for r in pii.identifiers(docs).select("doc_id", "spans").collect():
        out |= {(r["doc_id"], int(a), int(b)) for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind == "id"}
    return out


def test_precision_and_recall_of_unseen_identifiers(spark, frame):
    """Codes after contexts that seeds share are found; the same codes elsewhere, product numbers and failed cards are not."""
    rng = random.Random(4)
    contexts = ["please contact:", "write to", "Kontakt unter:"]
    pairs, planted, decoys = [], set(), 0
    for i in range(600):
        text = " ".join(words(i, 30, 500))
        kind = i % 6
        if kind < 2:
            text += f" {contexts[(i // 6) % 3]} user{i}@mail{i % 7}.example.com or so "
        elif kind == 2:
            value = code(rng)
            text += f" {contexts[(i // 6) % 3]} "
            planted.add((i, len(text), len(text) + len(value)))
            text += f"{value}, as said"
        elif kind == 3:
            text += f" in model {code(rng)} there is nothing new"
            decoys += 1
        elif kind == 4:
            text += f" it was {rng.randrange(10**7, 10**8)} of those and 4111 1111 1111 111{rng.randrange(2, 9)} too"
            decoys += 1
        pairs.append((i, text + " " + " ".join(words(i + 9000, 20, 500))))
    got = discovered(frame(pairs))
    assert len(planted) == 100 and decoys == 200, sorted(got - planted)[:5]
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.9 * len(got)


def test_keys_are_found_by_their_label(frame):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    pairs, planted = [], set()
    for i in range(80):
        text = " ".join(words(i, 20, 300)) + (" token = " if i % 2 else " checked at ")
        value = key() if i % 10 != 9 else f"K-{i}77-{i}99"
        if i % 2:
            planted.add((i, len(text) + 1, len(text) + 1 + len(value)))
            text += f'"{value}"'
        else:
            text += " ".join(words(i + 50, 3, 300)) + f" {value}"
        pairs.append((i, text + " " + " ".join(words(i + 7000, 5, 300))))
    assert discovered(frame(pairs)) == planted


def test_a_pattern_that_mostly_leads_elsewhere_finds_nothing(frame):
    pairs = [(i, f"you may write to user{i}@a.example now") for i in range(10)] + [(100 + i, f"you may write to {w} now") for i, w in enumerate(words(1, 60))] + [(200, "you may write to QX-1234-5678 now")]
    assert discovered(frame(pairs)) == set()
    assert discovered(frame([*pairs[:10], pairs[-1]])) == {(200, 17, 29)}


def test_words_beside_come_from_the_text_itself(frame):
    """Tokens with digits, tabs and line ends may stand between; seeds in rows of a table."""
    pairs = [(i, f"form W2\tcode nr:\n user{i}@mail.example.org end") for i in range(12)] + [(50, "form W2\tcode nr:\n AB-4471-9920-X end"), (51, "form W2 AB-4471-9920-Y then 77 end")]
    assert discovered(frame(pairs)) == {(50, 18, 32)}


def test_nothing_without_seeds(frame, empty):
    assert discovered(frame([(i, f"please contact: AB-44{i}-9920") for i in range(20)])) == set()
    assert discovered(frame([(1, None), (2, ""), (3, " "), (None, "a b 12345678")])) == set() and discovered(empty) == set()


def test_shuffled_patterns_agree_with_broadcast_ones(frame, monkeypatch):
    pairs = [(i, f"please contact: user{i}@mail.example and more") for i in range(9)] + [(20, "please contact: AB-4471-9920-X soon")]
    plain = discovered(frame(pairs))
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    assert discovered(frame(pairs)) == plain == {(20, 16, 30)}


def test_a_text_of_200_000_numbers(spark, frame):
    text = " ".join(f"word{i}" if i % 50 else f"u{i}@mail.example.com" for i in range(200_000))
    began = time.time()
    row = pii.identifiers(frame([(1, text), (2, "short")])).where("doc_id = 1").first()
    assert row["n_email"] == 4000 and row["spans"].startswith("email:0:19,email:") and time.time() - began < 60
    last = row["spans"].split(",")[-1].split(":")
    assert text[int(last[1]) : int(last[2])] == "u199950@mail.example.com"
    assert rows_of([(1, text)])[0][4] == len(text)
