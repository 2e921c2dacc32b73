"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

A text's set holds its distinct five-word shingles as 64-bit hashes. Equal sets
are one node. A node's signature is ``SYMBOLS`` minima, 16 bits of each. The
signature is cut into ``CHUNKS`` chunks of four; by the pigeonhole principle any
two signatures that differ in at most ``DISTANCE`` symbols agree in some chunk but
for one symbol at most, so each chunk is looked up with each one of its symbols
left open. All pairs within that distance meet in some bucket. At a similarity of
0.75 a pair differs in 16 of 64 symbols on average; more than 31 has a chance of
about 2 in 100 000.

Pairs are never expanded within a bucket. Round one links each node to one bucket
head and confirms that on the full sets. In round two, buckets that still hold
several components try their hub, the member that meets most others in such buckets:
variants of one text are alike to the text, but not to each other. Round three looks
only at buckets that are mixed even then: there the members outside the bucket's
largest component seek partners among all members, tile by tile. A tile is a block of
seekers and a block of members, either of at most about ``BLOCK`` nodes and
``BLOCK_SHINGLES`` shingles. A bucket of s members, r of them seekers, so makes
s * ceil(r / BLOCK) + r * ceil(s / BLOCK) rows of signatures: s + r as long as either
fits a block, whatever the size of the group that is linked already; only buckets with
many blocks of members that nothing links pay for comparing them. A tile
pairs up what it is the first to hold of all tiles that a pair shares. One
with few pairs of different components within the distance emits them; one with many
gets the texts of just the nodes that have such pairs, compares them as a whole, and
emits a spanning forest of the links found. So no link between components is lost,
and copies of one text cost one link each.

Edge cases: null and empty texts have an empty set, link with nothing, and stay;
fewer than five words are one shingle; a null id counts as missing (its text
stands in as the key; it can be a member but not the name of a component, unless
no member has an id); repeated rows are members of one component; different texts
that share an id are rows of their own, each in its own text's component. ``deduped``
leaves one row of each component, that with the smallest id (of texts that share it,
the one with the smallest hash; of rows that repeat both, one), and all rows without
words. An empty table gives an empty result; other columns are kept by ``deduped``
and ignored by ``membership``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import components, storage, textkit

SYMBOLS, WIDTH = 64, 4
CHUNKS = SYMBOLS // WIDTH
DISTANCE = 2 * CHUNKS - 1
SHARE_OF_100 = 75
#: Nodes of a block, and shingles, so long texts make smaller blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: A tile emits up to so many pairs for each of its nodes that has any.
PAIRS_A_NODE = 1
COLUMNS = 4096
#: Seekers that are compared with a tile's members at once.
SEEKERS = 16
MAIN, REST, SEEKER = 0, 1, 2
TEXTS_A_GROUP = 64
#: Up to so many ids (8 bytes each) a list is broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000

_FACTORS = np.random.default_rng(20_240_917).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_of() -> Column:
    """The id of a row, or for rows without one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``SYMBOLS`` 16-bit symbols for each set that isn't empty; empty sets give zeros."""
    rows = len(offs) - 1
    out, full = np.zeros((rows, SYMBOLS), np.uint16), np.flatnonzero(np.diff(offs))
    if len(full):
        for j in range(SYMBOLS):
            out[full, j] = textkit.mix(np.minimum.reduceat(values * _FACTORS[j], offs[full])) >> np.uint64(48)
    return out


def prints(values: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """A 128-bit fingerprint of each set; None for the empty set."""
    raw, at = values.tobytes(), (offs * 8).tolist()
    return [xxhash.xxh3_128_digest(raw[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, to, data, offs in textkit.slices(batch.column("text")):
            values, at = textkit.shingle_sets(data, offs)
            part = batch.slice(first, to - first)
            symbols = signatures(values, at)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_"), part.column("key_"), part.column("sum_"), pa.array(np.diff(at)), pa.array(prints(values, at), pa.binary()), textkit.binary_column(symbols.ravel(), np.arange(to - first + 1) * SYMBOLS)],
                names=["doc_id", "row_", "key_", "sum_", "n", "print", "sign"],
            )


def digests(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_"), key_of().alias("key_"), F.xxhash64("text").alias("sum_"), "text")
    return storage.staged(rows.mapInArrow(digested, "doc_id long, row_ long, key_ long, sum_ long, n long, print binary, sign binary"), "shingle-digests")


def nodes(digest: DataFrame) -> DataFrame:
    """One row for each distinct set: node, key_, print, n, sign, first_doc."""
    found = digest.where("n > 0").groupBy("print").agg(F.min(F.struct("row_", "key_", "n", "sign")).alias("r"), F.min("doc_id").alias("first_doc"))
    return storage.staged(found.select(F.col("r.row_").alias("node"), F.col("r.key_").alias("key_"), "print", F.col("r.n").alias("n"), F.col("r.sign").alias("sign"), "first_doc"), "shingle-nodes")


def matrix(column: pa.Array) -> np.ndarray:
    data, offs = textkit.buffers(column)
    return np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.uint16).reshape(-1, SYMBOLS)


def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node, chunk and open symbol: a bucket key of the chunk's number, the place, and the three other symbols."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            chunk = matrix(part.column("sign")).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
            node = part.column("node").to_numpy()
            for open_ in range(WIDTH):
                rest = [chunk[:, :, j] for j in range(WIDTH) if j != open_]
                key = ((np.arange(CHUNKS) * WIDTH + open_) << 48) | (rest[0] << 32) | (rest[1] << 16) | rest[2]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(node, CHUNKS))], names=["bucket", "node"])


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """From rows in order of ``keys``: the rows of each key together."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not len(batch):
            continue
        place = np.column_stack([batch.column(c).to_numpy() for c in keys])
        edges = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(batch)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if mark is not None and (place[a] != mark).any():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            mark = place[a]
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


TILE = ("bucket", "lo", "hi")
FOUND = pa.schema([(c, pa.int64()) for c in ("a", "b", *TILE)])


def first_meeting(agree: np.ndarray) -> np.ndarray:
    """The number, chunk and open place, of the first bucket that each pair shares, from one bit for each symbol that says whether it agrees."""
    by_chunk = np.unpackbits(agree[:, None].view(np.uint8), axis=1, bitorder="little").reshape(-1, CHUNKS, WIDTH)
    chunk = (by_chunk.sum(axis=2) >= WIDTH - 1).argmax(axis=1)
    return chunk * WIDTH + by_chunk[np.arange(len(chunk)), chunk].argmin(axis=1)


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tile its pairs (a, b) of different labels, fitting sizes and near signatures; or, if they are many, the nodes that have such, as (node, label, tile)."""
    for rows in runs(batches, TILE):
        node, label, n, side = (rows.column(c).to_numpy() for c in ("node", "label", "n", "side"))
        signs = matrix(rows.column("sign"))
        mark = [rows.column(c)[0].as_py() for c in TILE]
        others, has = np.flatnonzero(side != SEEKER), np.zeros(len(node), bool)
        theirs, found, count = signs[others], [], 0
        seekers = np.flatnonzero(side == SEEKER)
        for at in range(0, len(seekers), SEEKERS):
            own = seekers[at : at + SEEKERS]
            agree = np.packbits(theirs == signs[own][:, None, :], axis=2, bitorder="little").view(np.uint64)[..., 0]
            # Two seekers meet in two tiles, and pair in one of them.
            fits = (np.bitwise_count(agree) >= SYMBOLS - DISTANCE) & (label[others] != label[own, None]) & ((side[others] == MAIN) | (node[others] > node[own, None]))
            i, j = np.nonzero(fits)
            i, j, agree = own[i], others[j], agree[i, j]
            near = (100 * np.minimum(n[i], n[j]) >= SHARE_OF_100 * np.maximum(n[i], n[j])) & (first_meeting(agree) == mark[0] >> 48)
            i, j = i[near], j[near]
            count += len(i)
            has[i] = has[j] = True
            if len(i) and count <= PAIRS_A_NODE * len(node):
                found.append(np.column_stack([node[i], node[j]]))
        if count > PAIRS_A_NODE * has.sum():
            _, some = np.unique(np.where(has, node, -1), return_index=True)
            some = some[has[some]]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(label[some]), *(pa.array(np.full(len(some), v)) for v in mark)], schema=FOUND)
        elif found:
            both = np.concatenate(found)
            none = pa.nulls(len(both), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1)), none, none, none], schema=FOUND)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the values that two or more of them have."""
    size = np.array([len(s) for s in sets])
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), size), np.flatnonzero(uses > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(common), COLUMNS):
        own = (column >= at) & (column < at + COLUMNS)
        part = np.zeros((len(sets), min(COLUMNS, len(common) - at)), np.float32)
        part[row[own], column[own] - at] = 1
        out += part @ part.T
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tile, from the texts of its nodes: for every two labels that its links connect, a path of links between labels."""
    unpack = zstandard.ZstdDecompressor()
    for rows in runs(batches, TILE):
        node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        sets = []
        for raw in rows.column("pack"):
            data = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
            sets.append(textkit.shingle_sets(data, np.array([0, len(data)]))[0])
        shared, size = shared_counts(sets), np.array([len(s) for s in sets], np.float32)
        linked = 100 * shared >= SHARE_OF_100 * (size[:, None] + size[None, :] - shared)
        names, own = np.unique(label, return_inverse=True)
        one, other = np.nonzero(linked & (own[:, None] < own[None, :]))
        _, first = np.unique(own[one] * len(names) + own[other], return_index=True)
        root = list(range(len(names)))

        def top(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        tree = []
        for i, j in zip(one[first].tolist(), other[first].tolist(), strict=True):
            a, b = top(int(own[i])), top(int(own[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                tree.append((node[i], node[j]))
        if tree:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in tree], pa.int64()), pa.array([x for _, x in tree], pa.int64())], names=["u", "v"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of nodes, compressed; a row with the node's key but another set goes."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        expected, node = batch.column("print"), batch.column("node")
        for first, to, data, offs in textkit.slices(batch.column("text")):
            found = prints(*textkit.shingle_sets(data, offs))
            right = [k for k in range(to - first) if found[k] == expected[first + k].as_py()]
            if right:
                yield pa.RecordBatch.from_arrays([node.take(pa.array([first + k for k in right])), pa.array([press.compress(data[offs[k] : offs[k + 1]].tobytes()) for k in right], pa.binary())], names=["node", "pack"])


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (a, part, side): the pairs whose full sets are similar enough. The first row of a group is a's own text."""
    unpack = zstandard.ZstdDecompressor()
    own, own_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, side = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("side").to_numpy()
        found = []
        for i, raw in enumerate(batch.column("pack")):
            data = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
            values, _ = textkit.shingle_sets(data, np.array([0, len(data)]))
            if side[i] == 0:
                own, own_set = a[i], values
            elif own == a[i]:
                shared = len(np.intersect1d(own_set, values, assume_unique=True))
                if 100 * shared >= SHARE_OF_100 * (len(own_set) + len(values) - shared):
                    found.append((a[i], b[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])


def held_by(rows: DataFrame, ids: DataFrame, column: str | list[str], how: str) -> DataFrame:
    """``rows`` joined with a list of ids, which is broadcast if it is short."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def packs_of(docs: DataFrame, every: DataFrame, ids: DataFrame) -> DataFrame:
    """node, pack: the compressed text of each node of ``ids``."""
    wanted = storage.staged(ids.distinct().join(every.select("node", "key_", "print"), "node"), "near-wanted")
    texts = held_by(docs.select(key_of().alias("key_"), "text"), wanted, "key_", "inner")
    return storage.staged(texts.select("node", "print", "text").mapInArrow(packed, "node long, pack binary").dropDuplicates(["node"]), "near-packs")


def verified(pairs: DataFrame, packs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links, as (u, v). A hot node's partners are split into groups of bounded size."""
    parts = storage.staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXTS_A_GROUP).alias("parts")), "near-parts")
    split = storage.staged(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "near-split")
    partners = split.join(packs.withColumnRenamed("node", "b"), "b").select("a", "part", "b", F.lit(1).alias("side"), "pack")
    own = split.select("a", "part").distinct().join(packs.withColumnRenamed("node", "a"), "a").select("a", "part", F.col("a").alias("b"), F.lit(0).alias("side"), "pack")
    ordered = own.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return storage.staged(ordered.mapInArrow(confirmed, "u long, v long"), "near-links")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def tiles(members: DataFrame) -> DataFrame:
    """bucket, lo, hi, side, node, label: the tiles of buckets of several labels, from (bucket, node, label, n)."""
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    top = F.max(F.struct("size", F.negative("label").alias("label"), "n"))
    by = by_label.groupBy("bucket").agg(top.alias("top"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")

    def blocks(size: Column, n: Column) -> Column:
        return F.least(size, F.ceil(F.greatest(size / BLOCK, n / BLOCK_SHINGLES)))

    by = by.select("bucket", F.negative("top.label").alias("main"), blocks(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("rows"), blocks(F.col("size"), F.col("n")).alias("columns"))
    held = members.join(storage.staged(by, "near-blocks"), "bucket")
    every = held.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select("bucket", "lo", F.pmod(F.xxhash64("node"), F.col("columns")).alias("hi"), F.when(F.col("label") == F.col("main"), MAIN).otherwise(REST).alias("side"), "node", "label")
    seekers = held.where("label <> main").withColumn("hi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).select("bucket", F.pmod(F.xxhash64("node"), F.col("rows")).alias("lo"), "hi", F.lit(SEEKER).alias("side"), "node", "label")
    return every.unionByName(seekers)


def best_heads(stars: DataFrame, name: str) -> DataFrame:
    """(a, b): for each node b the head a that it shares most buckets with, from (head, node)."""
    times = stars.groupBy("head", "node").agg(F.count("*").alias("times"))
    best = times.groupBy("node").agg(F.max(F.struct("times", F.negative("head").alias("h"))).alias("best"))
    return storage.staged(best.select(F.negative("best.h").alias("a"), F.col("node").alias("b")), name)


def mixed(buckets: DataFrame, every: DataFrame, links_: DataFrame) -> DataFrame:
    """(bucket, node, label, n, size): members of the buckets of several components."""
    label = components.labels(links_)
    labelled = storage.staged(every.select("node", "n").join(label, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")), "near-labelled")
    members = storage.staged(buckets.join(labelled, "node").select("bucket", "node", "label", "n"), "near-members")
    held = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high").select("bucket", "size")
    # Staged, so that the join doesn't share an exchange with the counts, and Spark can split a hot bucket.
    return storage.staged(members.join(storage.staged(held, "near-mixed"), "bucket"), "near-mixed-members")


def hubs(members: DataFrame) -> DataFrame:
    """(head, node): the members of mixed buckets and their bucket's hub, where that is of another component."""
    degree = storage.staged(members.groupBy("node").agg(F.sum("size").alias("degree")), "near-degrees")
    hub = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", F.negative("node").alias("node"), "label")).alias("hub"))
    hub = storage.staged(hub.select("bucket", F.negative("hub.node").alias("head"), F.col("hub.label").alias("of")), "near-hubs")
    return members.join(hub, "bucket").where("label <> of").select("head", "node")


def links(docs: DataFrame, every: DataFrame) -> DataFrame:
    """node, label for nodes with links, from confirmed links that connect every component."""
    since = storage.mark()
    rows = every.select("node", "sign").mapInArrow(lookups, "bucket long, node long")
    heads = storage.staged(rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size"), "near-heads")
    buckets = storage.staged(rows.join(heads, "bucket"), "near-buckets")
    tried = best_heads(buckets.where("head <> node").select("head", "node"), "near-tried")
    first = verified(tried, packs_of(docs, every, ends(tried)))

    again = best_heads(hubs(mixed(buckets, every, first)), "near-tried")
    first = storage.staged(first.union(verified(again, packs_of(docs, every, ends(again)))), "near-star-links")

    blocks = storage.staged(tiles(mixed(buckets, every, first)), "near-tiles")
    signed = blocks.join(every.select("node", "n", "sign"), "node").repartition(*TILE).sortWithinPartitions(*TILE)
    found = storage.staged(signed.mapInArrow(crossing, "a long, b long, bucket long, lo long, hi long"), "near-found")
    pairs = storage.staged(found.where("bucket IS NULL").select("a", "b").distinct(), "near-pairs")
    filled = found.where("bucket IS NOT NULL").select(*TILE, F.col("a").alias("node"), F.col("b").alias("label"))
    packs = packs_of(docs, every, ends(pairs).union(filled.select("node")))
    second = verified(pairs, packs)
    whole = filled.join(packs, "node").repartition(*TILE).sortWithinPartitions(*TILE)
    third = storage.staged(whole.mapInArrow(compared, "u long, v long"), "near-tile-links")
    return storage.settled(storage.staged(components.labels(first.union(second).union(third)), "near-labels"), since)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, row_, key_, sum_, n_shingles, label, component_id, first_row: one row for each row of ``docs``; the last three null without words."""
    digest = digests(docs)
    every = nodes(digest)
    labelled = every.select("node", "print", "first_doc").join(links(docs, every), "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = storage.staged(labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"), F.min("node").alias("first_row")), "near-components")
    known = storage.staged(labelled.join(names, "label").select("print", "label", "component_id", "first_row"), "near-names")
    rows = digest.select("doc_id", "row_", "key_", "sum_", F.col("n").alias("n_shingles"), "print")
    # Rows without words have no print; kept apart, so that they don't all meet in one task.
    found = rows.where("n_shingles > 0").join(known, "print").drop("print")
    alone = rows.where("n_shingles = 0").drop("print").withColumns({c: F.lit(None).cast("long") for c in ("label", "component_id", "first_row")})
    return found.unionByName(alone)


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    first = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row_") == F.col("first_row")))
    alone = F.col("label").isNull()
    return named(docs).select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | first).alias("kept"))


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, and of texts that share it, the smallest hash."""
    keys = ["key_", "sum_"]
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), *keys)
    found = storage.staged(named(docs).where("label IS NOT NULL").groupBy("label", *keys).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "near-texts")
    best = storage.staged(found.groupBy("label").agg(F.min(rank).alias("best")), "near-best")
    judged = storage.staged(found.join(best, "label").select(*keys, "rows", (F.col("best") == rank).alias("stays")), "near-judged")
    rows = docs.select(F.struct("*").alias("row_"), key_of().alias("key_"), F.xxhash64("text").alias("sum_"))
    kept = held_by(rows, judged.where("NOT stays").select(*keys), keys, "left_anti")
    again = judged.where("stays AND rows > 1").select(*keys)
    if not again.limit(1).count():
        return kept.select("row_.*")
    once = held_by(kept, again, keys, "left_semi").dropDuplicates(keys)
    return held_by(kept, again, keys, "left_anti").unionByName(once).select("row_.*")


def op9_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(storage.table(spark, sf_dir, "documents"))
