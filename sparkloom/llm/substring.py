"""Substring deduplication: words covered by a run of SIZE words that also starts in a document of a smaller id go.

Windows of SIZE words are dealt by minimisers: the smallest hash among a window's GRAM-word runs. Consecutive windows with one
minimiser share a super-k-mer, a run of words that starts windows of that minimiser only, so equal windows always meet in
the bucket of their minimiser, and a text is cut into some words / 20 super-k-mers instead of its words.

1. Each document is cut; of a super-k-mer only minimiser, 128-bit digest and place are kept, and of those only where the minimiser occurs again. Equal ones are counted by digest, and a
   document that isn't the first to have one loses all of its windows there.
2. Where a minimiser has super-k-mers that differ, windows may be equal all the same: those super-k-mers, one copy of each,
   travel to the bucket as packed strings. There words are coded by a dictionary, windows are ranked by prefix doubling, which sorts
   them exactly, and each window gets the smallest id that has it.
3. A bucket of more than HOT different super-k-mers (the edges of a passage that very many documents share) isn't gathered: its
   windows are dealt singly, by 128-bit digest, and their smallest ids found by a partial aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.store import kept, scope, with_row_key

SIZE, GRAM = 50, 10
#: Windows of a super-k-mer at most; longer ones (periodic texts) are cut.
LONGEST = 1024
#: Different super-k-mers of one minimiser that are compared in one place.
HOT = 512
#: Words of packed strings that are sorted at once, about.
SORTED = 1 << 18
#: Documents whose keys are broadcast, at most, so that the others aren't shuffled.
KEYS = 1 << 19
_BYTES = np.arange(256)
_IS_WORD = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_VALUE = W.mix(np.arange(1, 257, dtype=np.uint64))
_KEY = "_substring_row"


class Packed:
    """Texts as words that are each followed by one space: data, and the offsets of words, with the end."""

    def __init__(self, column: pa.Array):
        self.words = words = W.split(column, _IS_WORD, _VALUE)
        length = words.end - words.start + 1
        self.offsets = np.concatenate([[0], np.cumsum(length)])
        self.data = np.full(self.offsets[-1], 32, np.uint8)
        inner = np.ones(len(self.data), bool)
        inner[self.offsets[1:] - 1] = False
        source = np.repeat(words.start - self.offsets[:-1], length) + np.arange(len(self.data))
        self.data[inner] = words.data[source[inner]]

    def text(self, start: int, stop: int) -> memoryview:
        """Words start to stop, joined by single spaces."""
        return memoryview(self.data[self.offsets[start] : max(self.offsets[stop] - 1, self.offsets[start])])


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` elements."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def super_kmers(words: W.Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser (int64) of every super-k-mer, in order."""
    n = len(words.hash)
    empty = np.empty(0, np.int64)
    if n < size:
        return empty, empty, empty
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9DDFEA08EB382D69) + words.hash[k : n - gram + 1 + k]
    low = _smallest(W.mix(grams), size - gram + 1)
    whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
    start = np.flatnonzero(whole)
    if not len(start):
        return empty, empty, empty
    low = low[start]
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    n_windows = np.diff(np.append(at, len(start)))
    pieces = -(-n_windows // LONGEST)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(start[at], pieces) + piece * LONGEST
    left = np.repeat(n_windows, pieces) - piece * LONGEST
    return first, np.minimum(left, LONGEST), np.repeat(low[at], pieces).view(np.int64)


def _digest(data: memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cut(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Of each document (id, text, row_key) a row of start -1 with its words (n) and the SHA-256 of all of them, and the places of its super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            packed = Packed(part.column("text"))
            words = packed.words
            first, n, low = super_kmers(words, size, gram)
            named = part.column("id").is_valid().to_numpy(zero_copy_only=False)
            ok = named[words.doc[first]] if len(first) else np.empty(0, bool)
            first, n, low = first[ok], n[ok], low[ok]
            digests = [_digest(packed.text(a, a + k + size - 1)) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            whole = [hashlib.sha256(packed.text(a, b)).digest() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            rows = np.concatenate([np.arange(part.num_rows), words.doc[first]])
            place = np.concatenate([np.full(part.num_rows, -1), first - words.first[words.doc[first]]]).astype(np.int32)
            taken = part.select(["id", "row_key"]).take(pa.array(rows))
            halves = np.frombuffer(b"\0" * 16 * part.num_rows + b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            key = taken.column("row_key")
            columns = [taken.column("id"), key.field("file"), key.field("place"), pa.array(np.concatenate([np.zeros(part.num_rows, np.int64), low])), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            columns += [pa.array(place), pa.array(np.concatenate([words.count, n]).astype(np.int32)), pa.array(whole + [None] * len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "file", "place", "low", "d1", "d2", "start", "n", "whole"])

    return docs.mapInArrow(run, "id long, file long, place long, low long, d1 long, d2 long, start int, n int, whole binary")


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs of these row keys, where they are few enough to be broadcast; all of them otherwise."""
    return docs.join(F.broadcast(keys.select("row_key").distinct()), "row_key", "left_semi") if keys.limit(KEYS + 1).count() <= KEYS else docs


def packed_strings(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """low, digest, first and packed of the super-k-mers wanted (row_key, low, digest, first, start, n), read from their documents."""
    lists = wanted.groupBy("row_key").agg(F.collect_list(F.struct("low", "digest", "first", "start", "n")).alias("places"))  # no more than a document has
    both = _only(docs, wanted).join(lists, "row_key").select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            packed = Packed(part.column("text"))
            lists = part.column("places")
            found = lists.flatten()
            start, n = (found.field(x).to_numpy() for x in ("start", "n"))
            doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            at = packed.words.first[doc] + start
            texts = [bytes(packed.text(a, b)) for a, b in zip(at.tolist(), (at + n + size - 1).tolist(), strict=True)]
            for k in range(0, len(texts), 4096):
                some = found.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([some.field("low"), some.field("digest"), some.field("first"), pa.array(texts[k : k + 4096], pa.binary())], ["low", "digest", "first", "packed"])

    return both.mapInArrow(run, "low long, digest binary, first long, packed binary")


def earlier_windows(packed: list[bytes], first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and last window (exclusive) of each run of windows that a string of a smaller id has too."""
    ends = b"".join(x + b" " for x in packed)
    data = np.frombuffer(ends, np.uint8)
    stop = np.flatnonzero(data == 32) + 1
    offsets = np.concatenate([[0], stop])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ends)]).dictionary_encode()
    rank = coded.indices.to_numpy().astype(np.int64)
    string = np.repeat(np.arange(len(packed)), np.diff(np.searchsorted(stop, np.concatenate([[0], np.cumsum([len(x) + 1 for x in packed])]), "right")))
    span = 1

    def pairs(by: int) -> np.ndarray:
        return np.unique(rank[:-by] * (rank.max() + 1) + rank[by:], return_inverse=True)[1]

    while span * 2 <= size:
        rank = pairs(span)
        span *= 2
    if size > span:
        rank = pairs(size - span)
    at = np.flatnonzero(string[: len(rank)] == string[size - 1 :])
    rank, owner = rank[at], string[at]
    low = np.full(rank.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, rank, first[owner])
    at, owner = at[hit := low[rank] < first[owner]], owner[hit]
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    origin = np.searchsorted(string, owner[begin])
    n = np.diff(np.append(begin, len(at)))
    return owner[begin], at[begin] - origin, at[begin] - origin + n


def _runs(low: list, digest: list, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    owner, begin, end = found
    columns = [pa.array([low[k] for k in owner.tolist()], pa.int64()), pa.array([digest[k] for k in owner.tolist()], pa.binary()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["low", "digest", "begin", "end"])


def bucket_runs(strings: DataFrame, size: int) -> DataFrame:
    """low, digest, begin, end: runs of windows of a super-k-mer that one of a smaller first id has too, in the same bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[int] = []
        digest, packed, first, held = [], [], [], 0
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("low", "digest", "packed", "first")), strict=True):
                if held > SORTED and a != low[-1]:  # equal windows are in one bucket, so buckets may be sorted together
                    yield _runs(low, digest, earlier_windows(packed, np.array(first), size))
                    low, digest, packed, first, held = [], [], [], [], 0
                low.append(a), digest.append(b), packed.append(c), first.append(d)
                held += c.count(b" ") + 1
        if low:
            yield _runs(low, digest, earlier_windows(packed, np.array(first), size))

    return strings.repartition("low").sortWithinPartitions("low").mapInArrow(run, "low long, digest binary, begin int, end int")


def single_windows(strings: DataFrame, size: int) -> DataFrame:
    """The same for buckets that are too large to gather: each window is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, "packed"):
            packed = Packed(part.column("packed"))
            words = packed.words
            at = np.flatnonzero(words.doc[: max(len(words.doc) - size + 1, 0)] == words.doc[size - 1 :])
            for k in range(0, len(at), 1 << 15):
                some = at[k : k + (1 << 15)]
                window = [_digest(packed.text(a, a + size)) for a in some.tolist()]
                rows = part.select(["low", "digest", "first"]).take(pa.array(words.doc[some]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((some - words.first[words.doc[some]]).astype(np.int32)), pa.array(window, pa.binary())], ["low", "digest", "first", "begin", "window"])

    windows = kept(strings.mapInArrow(run, "low long, digest binary, first long, begin int, window binary"), "windows")
    least = windows.groupBy("window").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("window", "least")
    return windows.join(least, "window").where("least < first").select("low", "digest", "begin", (F.col("begin") + 1).alias("end"))


def repeated_spans(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """row_key and spans: the words (from, to) of each document that windows of smaller ids cover."""
    places = places.where("start >= 0").drop("whole")
    # minimisers that occur once, most of all, take part in nothing more
    spread = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    buckets = kept(places.groupBy("low").agg(F.count(F.lit(1)).alias("c"), spread.alias("mixed")).where("c > 1").drop("c"), "buckets")
    digest = F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in ("d1", "d2"))))
    shared = kept(places.join(buckets, "low").select("id", F.struct("file", "place").alias("row_key"), "low", digest.alias("digest"), "start", "n", "mixed"), "shared")
    strings = kept(shared.groupBy("low", "digest", "mixed").agg(F.min("id").alias("first")), "strings")
    kinds = strings.where("mixed").groupBy("low").agg(F.count(F.lit(1)).alias("kinds"))
    mine = kept(shared.drop("mixed").join(strings.join(kinds, "low", "left").drop("mixed"), ["low", "digest"]).where("id > first or kinds is not null"), "places")
    wanted = mine.where("kinds is not null and id = first").groupBy("low", "digest", "first", "kinds").agg(F.min(F.struct("row_key", "start", "n")).alias("p"))
    wanted = kept(wanted.select("low", "digest", "first", "kinds", "p.*"), "wanted")
    runs = bucket_runs(packed_strings(docs, wanted.where(f"kinds <= {HOT}"), size), size)
    if not (hot := wanted.where(f"kinds > {HOT}")).isEmpty():
        runs = runs.unionByName(single_windows(packed_strings(docs, hot, size), size))
    spans = mine.where("id > first").select("row_key", F.col("start").alias("from"), (F.col("start") + F.col("n") + size - 1).alias("to"))
    spans = spans.unionByName(mine.where("id = first").join(runs, ["low", "digest"]).select("row_key", (F.col("start") + F.col("begin")).alias("from"), (F.col("start") + F.col("end") + size - 1).alias("to")))
    return kept(spans.groupBy("row_key").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")  # no more than a document has windows


def cleaned(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row_key, n_removed, kept (the words that stay, joined by one space) and its SHA-256, of the documents that have spans."""
    both = _only(docs, spans).join(spans, "row_key").select("row_key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            packed = Packed(part.column("text"))
            first = packed.words.first
            lists = part.column("spans")
            found = lists.flatten()
            base = np.repeat(first[:-1], lists.value_lengths().to_numpy())
            change = np.zeros(len(packed.words.doc) + 1, np.int64)
            np.add.at(change, base + found.field("from").to_numpy(), 1)
            np.add.at(change, base + found.field("to").to_numpy(), -1)
            gone = np.cumsum(change[:-1]) > 0
            keep = packed.data[np.repeat(~gone, np.diff(packed.offsets))]
            ends = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(packed.offsets)))])[first]
            texts = [bytes(memoryview(keep[a : max(b - 1, a)])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            total = np.concatenate([[0], np.cumsum(gone)])[first]
            columns = [part.column("row_key"), pa.array(np.diff(total)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "n_removed", "kept", "digest"])

    return both.mapInArrow(run, "row_key struct<file: long, place: long>, n_removed long, kept string, digest binary")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed and kept_sha256, of the words that stay joined by one space.

    Words are runs of anything but ASCII white space, unchanged. A window is ``size`` words of one document; each word covered by a
    window that also starts in a document of a smaller id is removed, judged on the input. So rows of one id keep what they share,
    and what repeats inside a document stays. A null text has no words; a row with a null id (ids are integers) neither loses words nor takes any.
    Other columns aren't read; an empty table gives an empty result.
    """
    source = with_row_key(docs, _KEY).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(_KEY).alias("row_key"))
    with scope(docs.sparkSession) as stay:
        places = kept(cut(source, size, gram), "cut")
        changed = kept(cleaned(source.select("row_key", "text"), repeated_spans(source.select("row_key", "text"), places, size)).drop("kept"), "cleaned")
        stay += [places, changed]
    heads = places.where("start < 0").select("id", F.struct("file", "place").alias("row_key"), F.col("n").cast("long").alias("n_words"), "whole")
    return heads.join(changed, "row_key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("digest", "whole"))).alias("kept_sha256")
    )
