"""Vectorised word splitting and hashing over Arrow strings, shared by the operators that work on words.

A word is a maximal run of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; in UTF-8 that is a property
of single bytes, so whole record batches are split and hashed with a few numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers whose bits look random."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for every byte, lower case for A-Z.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory, as Spark's Python workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about ``limit`` bytes of text, or one row. Gives memory back after each batch."""
    limit = limit or CHUNK_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        give_back()


@dataclass
class Words:
    """All words of a column of texts, in order."""

    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    hash: np.ndarray  # uint64 of the lower-cased word
    doc: np.ndarray  # row of each word
    count: np.ndarray  # words of each row
    first: np.ndarray  # index of each row's first word, and the total
    data: np.ndarray
    offsets: np.ndarray


def split(column: pa.Array, is_word: np.ndarray = _IS_WORD, value: np.ndarray = _VALUE) -> Words:
    """is_word, value: whether a byte belongs to words, and the random value of each byte."""
    data, offsets = string_parts(column)
    n = len(data)
    inside = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    if n:
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * powers(_BASE, n), out=total[1:])
    hashed = mix((total[end] - total[start]) * powers(_INVERSE, n)[start])
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    return Words(start, end, hashed, np.repeat(np.arange(len(count)), count), count, first, data, offsets)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words; a shorter row that has words gives one run of all of them."""
    at = np.arange(len(words.hash))
    left = words.first[1:][words.doc] - at if len(at) else at
    length = np.minimum(words.count[words.doc], size) if len(at) else at
    at = at[left >= length]
    doc, length = words.doc[at], length[at] if len(at) else at
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = k < length
        out[more] = mix(out[more] * np.uint64(0x9DDFEA08EB382D69 | 1) + words.hash[at[more] + k])
    return doc, out


def bag(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and multiplicity of the distinct shingles of each row, rows ascending."""
    doc, value = shingles(words, size)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))
