"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds of identifiers have a form of their own; these base spans are seeds, and so
are key-like strings, long runs of letters and digits mixed. What stands around an
identifier are its lexical patterns: the two words before it, the two after it, and a
label, a name with a colon, an equals sign or a hash sign before it, in its own word or
in the last one. Every other token that looks like an identifier is an instance that
some patterns lead to. Scores pass to and fro over that graph: a pattern's score is the
score of the instances at its occurrences, summed, over all its occurrences in the
corpus, whatever stands there; an instance's is that of its best pattern, and base seeds
keep score 1. Key-like strings start at 1 too, but must then live by their patterns.
Instances that reach ``CONFIDENCE`` through a pattern with ``LEAST_SEEDS`` different seeds
are unseen identifiers, of kind ``id``.

The graph is a staged table of (pattern, instance) pairs with counts, summed before it is
shuffled; scores join it by key, in rounds of fixed number. A pattern counts if it could
reach ``CONFIDENCE``: if identifiers stand at that share of its places at least. Texts
are read for tokens, and again for the places of patterns with enough seeds. Common
words precede some seeds in any large corpus; so that they aren't counted all through
it, places are counted in growing ``PARTS`` of the documents first, and what already has
too many there is dropped: counts only grow, so nothing else would come of it.

Edge cases: null counts as empty and has no spans; an empty table gives an empty
result; without seeds nothing is discovered; repeated rows get the same spans;
rows without id are found like others; other columns are ignored. Offsets are
code points, the end excluded. What has the form of a base kind but fails its check
is no instance, nor is a part of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import storage

KINDS = ("email", "ip", "card", "phone", "id")
#: Java forms of the four base patterns. Possessive repeats and the looks behind change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that these don't find have no match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A whole token with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What may stand before an identifier in its token: a name and a sign, or opening marks.
LABEL = r"^(?:[A-Za-z_.-]+[=:#])?[\"'(\[<{]*"
TAIL = r"(?<![.,;:!?\"')\]>}*#$%&|])[.,;:!?\"')\]>}*#$%&|]++$"
#: Long runs of letters and digits, with several of both.
KEY_LIKE = r"^(?=(?:[^0-9]*[0-9]){6})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_-]{24,}={0,2}$"
#: Stands for the characters of a base match in texts that are searched for other tokens.
MASK = "\ue000"
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
LEAST_LENGTH, LEAST_DIGITS = 8, 2
ROUNDS, CONFIDENCE, LEAST_SEEDS = 3, 0.6, 3
#: Characters beside a match that are kept; its words are the last or first two whole ones in there.
BESIDE = 80
#: One in so many documents, by a hash of the text; the last count is over all.
PARTS = (4096, 64, 1)
#: Up to so many patterns (a few dozen bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_PATTERNS = 200_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def pieces(text: Column, pattern: str) -> Column:
    """(p, m): what lies before each match, and the match; the last has no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))


def located(text: Column, pattern: str, hint: str) -> Column:
    """The matches, leftmost first: array of (start, m, before, after). Places follow from the lengths of what lies between.

    Appending to an array copies it, so n matches are taken in blocks of about the root of n:
    lengths are summed by block, then places are counted from each block's start.
    """
    kind = "array<struct<start:int,m:string,before:string,after:string>>"
    empty = F.array().cast(kind)
    length = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    joined = lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))

    def with_sides(parts: Column) -> Column:
        nth = F.sequence(F.lit(0), F.size(parts) - 1)

        def side(i: Column) -> Column:
            left = F.concat(*[F.when(i >= k, F.right(joined(F.get(parts, i - k)), F.lit(BESIDE))).otherwise("") for k in (2, 1)], F.get(parts, i)["p"])
            right = F.concat(F.left(F.get(parts, i + 1)["p"], F.lit(BESIDE)), F.coalesce(F.left(F.get(parts, i + 1)["m"], F.lit(BESIDE)), F.lit("")))
            x = F.get(parts, i)
            return F.struct(x["p"].alias("p"), x["m"].alias("m"), F.right(left, F.lit(BESIDE)).alias("before"), F.left(right, F.lit(BESIDE)).alias("after"))

        return F.transform(nth, side)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        more = F.array_append(acc["out"], F.struct(start.alias("start"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((acc["pos"] + length(x)).alias("pos"), F.when(x["m"].isNull(), acc["out"]).otherwise(more).alias("out"))

    def in_blocks(parts: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(parts))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / side).cast("int")), lambda b: F.slice(parts, b * side + 1, side))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + length(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.when(block.isNull(), empty).otherwise(F.aggregate(block, F.struct(at.alias("pos"), empty.alias("out")), step, lambda acc: acc["out"]))))

    return F.when(text.rlike(hint), let(let(pieces(text, pattern), with_sides), in_blocks)).otherwise(empty)


def masked(text: Column) -> Column:
    """The text with ``MASK`` for each character of a base match, valid or not."""

    def without(kind: str, pattern: str) -> Callable[[Column], Column]:
        hidden = lambda t: F.transform(pieces(t, pattern), lambda x: F.concat(x["p"], F.coalesce(F.repeat(F.lit(MASK), F.length(x["m"])), F.lit(""))))
        return lambda t: F.when(t.rlike(HINTS[kind]), F.array_join(hidden(t), "")).otherwise(t)

    for kind, pattern in PATTERNS.items():
        text = let(text, without(kind, pattern))
    return text


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """From the right, every second digit doubled, less 9 if above 9; the sum ends in 0."""
    places = F.split(F.reverse(digits(s)), "")
    total = F.aggregate(
        F.transform(F.filter(places, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + b
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    right = F.filter(located(text, PATTERNS[kind], HINTS[kind]), lambda x: valid(kind, x["m"]))
    return F.transform(right, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))


def written(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """row_, doc_id, base (array of spans with what they say and stand beside), tokens (array of start, m, before, after), text."""
    rows = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row_"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("row_", "doc_id", "text", F.concat(*[spans(text, k) for k in PATTERNS]).alias("base"), masked(text).alias("rest"))
    tokens = F.filter(located(F.col("rest"), TOKEN, "[0-9]"), lambda x: (F.length(x["m"]) >= LEAST_LENGTH) & ~F.contains(x["m"], F.lit(MASK)))
    return storage.staged(rows.select("row_", "doc_id", "base", tokens.alias("tokens")), "pii-scan")


def plain(beside: Column) -> Column:
    """Lower-cased; base matches and digits all alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(beside), f"{MASK}+", MASK), "[0-9]+", "0")


def last_words(before: Column, n: int) -> Column:
    return F.regexp_extract(before, rf"((?:{WORD}{BLANK}){{{n - 1}}}{WORD}){BLANK}$", 1)


def first_words(after: Column, n: int) -> Column:
    return F.regexp_extract(after, rf"^{BLANK}({WORD}(?:{BLANK}{WORD}){{{n - 1}}})", 1)


def gram(words: Column, kind: str) -> Column:
    """A pattern as a number: its kind, and its words parted by single blanks."""
    return F.when(words != "", F.xxhash64(F.lit(kind), F.regexp_replace(words, BLANK, " ")))


def occurrences(scanned: DataFrame) -> DataFrame:
    """row_, start, end, instance, base, key_like, patterns: all base spans, and the tokens that look like identifiers."""
    found = scanned.select("row_", F.explode("base").alias("t")).select("row_", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.m").alias("instance"), F.lit("").alias("label"), F.col("t.before").alias("before"), F.col("t.after").alias("after"), F.lit(True).alias("base"))
    rows = scanned.select("row_", F.explode("tokens").alias("t"))
    rows = rows.select("row_", F.col("t.start").alias("at"), F.col("t.before").alias("before"), F.col("t.after").alias("after"), F.regexp_extract("t.m", LABEL, 0).alias("label"), F.regexp_replace("t.m", LABEL, "").alias("rest"))
    rows = rows.withColumn("instance", F.regexp_replace("rest", TAIL, "")).withColumn("start", F.col("at") + F.length("label"))
    rows = rows.where((F.length("instance") >= LEAST_LENGTH) & (F.length(digits(F.col("instance"))) >= LEAST_DIGITS))
    rows = rows.select("row_", "start", (F.col("start") + F.length("instance")).alias("end"), "instance", "label", "before", "after", F.lit(False).alias("base"))
    every = found.unionByName(rows).withColumns({c: plain(F.col(c)) for c in ("before", "after", "label")})
    own = F.regexp_extract("label", r"^[a-z_.-]+[=:#]", 0)
    said = F.regexp_extract(last_words(F.col("before"), 2), rf"({WORD}[=:#]|{WORD}{BLANK}[=:#])$", 1)
    label = F.when(own != "", own).otherwise(said)
    # A label of its own word takes the place of the last word before; tokens that begin with other marks follow words like any.
    left = F.when(own != "", F.concat(last_words(F.col("before"), 1), F.lit(" "), own)).otherwise(last_words(F.col("before"), 2))
    patterns = F.array_compact(F.array(gram(label, "label"), gram(left, "left"), gram(first_words(F.col("after"), 2), "right")))
    return every.select("row_", "start", "end", "instance", "base", F.col("instance").rlike(KEY_LIKE).alias("key_like"), patterns.alias("patterns"))


def able(patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, places: of (pattern, times), those whose places, over all texts, don't outnumber their identifiers too far."""
    for part in PARTS:
        some = docs if part == 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
        counted = patterns.join(places(some, patterns), "pattern", "left").withColumn("places", F.greatest("times", F.coalesce("places", F.lit(0))))
        patterns = storage.staged(counted.where(F.col("times") >= CONFIDENCE * F.col("places")).select("pattern", "times", *(["places"] if part == 1 else [])), f"pii-able-{part}")
    return patterns.select("pattern", "places")


def places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, places: where in the texts each pattern stands, whatever is beside it. ``patterns`` is staged, one row each."""
    words = F.split(F.trim(F.regexp_replace(plain(masked(F.coalesce("text", F.lit("")))), BLANK, " ")), " ")
    rows = docs.select(words.alias("w")).withColumn("n", F.size("w") - 1)
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))
    rows = rows.withColumn("pairs", F.when(F.col("n") > 0, pairs).otherwise(F.array().cast("array<string>")))
    signed = lambda w: F.contains(w, F.lit("=")) | F.contains(w, F.lit(":")) | F.contains(w, F.lit("#"))
    own = F.transform(F.filter("w", lambda w: signed(w) & w.rlike("^[^=:#]+[=:#]")), lambda w: F.regexp_extract(w, "^[^=:#]+[=:#]", 0))
    apart = F.filter("pairs", lambda w: signed(w) & w.rlike(" [=:#]$"))
    # A pair whose second word begins with a label ends after its sign.
    left = F.transform("pairs", lambda w: F.when(signed(w), F.regexp_replace(w, "( [a-z_.-]+[=:#]).+$", "$1")).otherwise(w))
    named = lambda grams, kind: F.transform(grams, lambda w: F.xxhash64(F.lit(kind), w))
    grams = F.concat(named(F.concat(own, apart), "label"), named(left, "left"), named("pairs", "right"))
    side = patterns.select("pattern")
    side = F.broadcast(side) if patterns.count() <= BROADCAST_PATTERNS else side
    return storage.staged(rows.select(F.explode(grams).alias("pattern")).join(side, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places")), "pii-places")


def scored(docs: DataFrame, found: DataFrame) -> DataFrame:
    """instance, score: instances other than base spans that reach ``CONFIDENCE``."""
    edges = found.select("instance", "base", "key_like", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("base").alias("base"), F.max(F.col("base") | F.col("key_like")).alias("seed"), F.count("*").alias("times"))
    edges = storage.staged(edges, "pii-graph")
    likely = storage.staged(edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.sum("times").alias("times")).where(F.col("seeds") >= LEAST_SEEDS).select("pattern", "times"), "pii-likely")
    likely = able(likely, docs)
    side = F.broadcast(likely) if likely.count() <= BROADCAST_PATTERNS else likely
    edges = storage.staged(edges.join(side, "pattern"), "pii-edges")
    instances = edges.groupBy("instance").agg(F.max("base").alias("base"), F.max(F.col("seed").cast("double")).alias("score"))
    for k in range(ROUNDS):
        weights = edges.join(instances.select("instance", "score"), "instance").groupBy("pattern").agg((F.sum(F.col("times") * F.col("score")) / (F.max("places") + 1.0)).alias("weight"))
        weights = storage.staged(weights, f"pii-weights-{k}")
        reached = edges.join(weights, "pattern").groupBy("instance").agg(F.max("base").alias("base"), F.max("weight").alias("best"))
        instances = storage.staged(reached.select("instance", "base", F.when(F.col("base"), 1.0).otherwise(F.col("best")).alias("score")), f"pii-instances-{k}")
    return instances.where(~F.col("base") & (F.col("score") >= CONFIDENCE)).select("instance", "score")


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans: one row a document."""
    scanned = scan(docs)
    found = storage.staged(occurrences(scanned), "pii-tokens")
    since = storage.mark()
    unseen = storage.settled(storage.staged(scored(docs, found), "pii-unseen"), since)
    extra = found.where("NOT base").join(unseen.select("instance"), "instance").groupBy("row_").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("id")).alias("nth"), F.lit("id").alias("kind"), "end")).alias("extra"))
    base = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "nth", "kind", "end")]))
    rows = scanned.select("row_", "doc_id", base.alias("base")).join(extra, "row_", "left")
    none = F.array().cast("array<struct<start:int,nth:int,kind:string,end:int>>")
    more = F.coalesce("extra", none)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in PATTERNS]
    total = (F.size("base") + F.size(more)).cast("long")
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_discovered"), total.alias("n_spans"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(storage.table(spark, sf_dir, "documents"))
