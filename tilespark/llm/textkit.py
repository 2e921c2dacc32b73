"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, shingles, hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; letters A-Z count as a-z.
Everything is computed on slices of a few MB, so memory follows the slice or the
longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
LONG_WORD = 256
SHINGLE = 5

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters only: all of ASCII but A-Z and a-z parts words; bytes of other scripts don't.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _C2
    h = (h ^ (h >> _U(27))) * _C3
    return h ^ (h >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts and ends in them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    data, offs = buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def loads(data: np.ndarray) -> np.ndarray:
    """At index i the eight bytes from i on as a little-endian number; bytes past the end read as 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 8,), (1,))


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its row. ``between`` says of each byte value whether it parts words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~between[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = ~solid[:-1]
    last[:-1] = ~solid[1:]
    edges = offs[(offs > 0) & (offs < len(data))]
    first[edges], last[edges - 1] = True, True
    starts, ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    low = _LOWER[data]
    at8, size = loads(low), ends - starts
    h = size.astype(_U) * _C1
    todo = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(todo):
        left = size[todo] - step
        x = at8[starts[todo] + step].astype(_U)
        short = left < 8
        x[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        h[todo] = mix(h[todo] ^ x) + _C1
        todo = todo[left > 8]
        step += 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = _U(xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes()))
    return h


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, with its row, by row; a row with fewer words gives one hash of them all."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(h)
    if n >= width:
        inside = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
        s = np.full(len(inside), _C1, _U)
        for j in range(width):
            s = s * _C3 + h[inside + j]
        s, own = mix(s), row[inside]
    else:
        s, own = np.zeros(0, _U), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.full(len(few), _C2, _U)
        for j in range(width - 1):
            has = count[few] > j
            short[has] = short[has] * _C3 + h[first[few[has]] + j]
        s, own = np.concatenate([s, mix(short + count[few].astype(_U))]), np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        s, own = s[order], own[order]
    return s, own


def distinct_sets(s: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted within it, and the offsets of the rows."""
    offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    s = s.copy()
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))])


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The set of shingle hashes of each row, and the offsets of the rows."""
    starts, ends, row = words(data, offs)
    s, own = shingles(word_hashes(data, starts, ends), row, len(offs) - 1, width)
    return distinct_sets(s, own, len(offs) - 1)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value a row: the bytes of ``values`` between its offsets."""
    at = np.asarray(offsets, np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def filtered(docs: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """The rows of ``docs`` that a function of their texts (bytes, offsets) keeps; ``make`` makes it in a task. Every column crosses to Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = make()
        for batch in batches:
            for first, to, data, offs in slices(batch.column("text")):
                yield batch.slice(first, to - first).filter(pa.array(np.asarray(keeps(data, offs), bool)))

    return docs.mapInArrow(run, docs.schema)
