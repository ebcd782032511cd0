"""Benchmark decontamination with an FM-index over every training shard.

Each task cuts its rows into shards of a bounded number of symbols and indexes a shard's word sequence: suffix order by
prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every 16th symbol.
All windows of the benchmark are searched backwards at once; every occurrence is located by walking back to a sampled
position, and overlapping occurrences are merged into removal spans.

The index alphabet is the benchmark's vocabulary. A word outside it can't be part of an occurrence, nor can a run of
vocabulary words shorter than the shortest window, so such words become one separator each before indexing: this changes
no result. Nothing is shuffled; memory is bounded by the shard size and by the longest single text.

The benchmark goes to every task, in blocks, and its size is checked against ``max_benchmark_bytes`` first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W

WINDOW = 10
#: Symbols of a shard's index; a longer single text is a shard of its own.
SHARD_SYMBOLS = 1 << 18
SAMPLE = 16
#: Windows searched at once.
BLOCK_WINDOWS = 1 << 18
MAX_BENCHMARK_BYTES = 256 << 20
#: Bytes of documents that wait for the verdict of their shard in ``removed``, about.
HELD_BYTES = 4 << 20

OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is a separator of its own, ordered by position."""
    n, stop = len(sym), sym == 0
    rank = np.where(stop, np.cumsum(stop) - 1, stop.sum() + sym).astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and locate over a sequence of symbols 1..sigma-1, each run of which ends with a 0."""

    def __init__(self, sym: np.ndarray, sigma: int):
        order = suffix_order(sym)
        self.n = len(sym)
        self.bwt = sym[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.split = [], []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            level = np.concatenate([level[~one], level[one]])
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.nth = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before row i[k] in the transform."""
        low = np.zeros(len(c), np.int64)
        i = i.astype(np.int64)
        for b, zeros, split in zip(range(self.bits - 1, -1, -1), self.zeros, self.split, strict=True):
            one = (c >> b & 1).astype(bool)
            l0, i0 = zeros[low], zeros[i]
            low, i = np.where(one, split + low - l0, l0), np.where(one, split + i - i0, i0)
        return i - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows that start with each pattern (rows of a matrix, filled up with 0)."""
        sp, ep = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            at = np.flatnonzero((lengths >= back) & (sp < ep))
            if not len(at):
                break
            c = patterns[at, lengths[at] - back].astype(np.int64)
            sp[at], ep[at] = self.below[c] + self.rank(c, sp[at]), self.below[c] + self.rank(c, ep[at])
        return sp, np.maximum(sp, ep)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.position[self.nth[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            c = self.bwt[rows].astype(np.int64)
            rows = self.below[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The benchmark's windows as rows of word ids, in blocks, with the items that hold each."""

    def __init__(self, items: Iterator[tuple[str | None, str | None]], window: int):
        seen: dict[bytes, int] = {}
        owners: list[set[int]] = []
        self.names: list[str | None] = []
        numbers: dict[str | None, int] = {}
        vocab: dict[int, int] = {}
        for name, text in items:
            h = W.split(pa.array([text or ""])).hash
            if not len(h):
                continue
            ids = np.array([vocab.setdefault(x, len(vocab) + 1) for x in h.tolist()], np.int32)
            number = numbers.setdefault(name, len(numbers))
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                at = seen.setdefault(ids[k : k + size].tobytes(), len(owners))
                if at == len(owners):
                    owners.append(set())
                owners[at].add(number)
        self.names = list(numbers)
        keys = np.fromiter(vocab, np.uint64, len(vocab))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], (order + 1).astype(np.int32)
        self.sigma = len(vocab) + 1
        self.lengths = np.array([len(k) // 4 for k in seen], np.int64)
        self.patterns = np.zeros((len(seen), window), np.int32)
        for row, k in zip(self.patterns, seen, strict=True):
            row[: len(k) // 4] = np.frombuffer(k, np.int32)
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([y for x in owners for y in sorted(x)], np.int64)
        self.shortest = int(self.lengths.min()) if len(seen) else 0
        # a small table that most other words fail, so that few need the binary search
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word, 0 if the benchmark doesn't have it."""
        out = np.zeros(len(hashes), np.int32)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        out[at[same]] = self.ids[k[same]]
        return out


class _Shard:
    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.parts, self.size = phrases, [], [], 0

    def add(self, ids: pa.Array, words: W.Words) -> None:
        p, first = self.phrases, sum(len(n) for _, n in self.rows)
        self.rows.append((ids, words.count))
        if not len(words.hash) or not p.shortest:
            return
        sym = p.symbols(words.hash)
        n = len(sym)
        run_ends = np.flatnonzero((sym != 0) & np.append((sym[1:] == 0) | (words.doc[1:] != words.doc[:-1]), True))
        run_starts = np.flatnonzero((sym != 0) & np.insert((sym[:-1] == 0) | (words.doc[1:] != words.doc[:-1]), 0, True))
        fits = run_ends - run_starts + 1 >= p.shortest
        run_starts, size = run_starts[fits], (run_ends - run_starts + 1)[fits]
        if not len(size):
            return
        # every run is followed by one separator
        ends = np.cumsum(size + 1)
        at = np.arange(ends[-1]) - np.repeat(ends - size - 1, size + 1) + np.repeat(run_starts, size + 1)
        stop = np.zeros(ends[-1], bool)
        stop[ends - 1] = True
        at = np.minimum(at, n - 1)
        doc = np.repeat(words.doc[run_starts], size + 1)
        letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        base = letters[words.offsets[:-1]][doc]
        self.parts.append((np.where(stop, 0, sym[at]), first + doc, letters[words.start[at]] - base, letters[words.end[at]] - base))
        self.size += len(at)

    def result(self) -> Iterator[pa.RecordBatch]:
        p, total = self.phrases, sum(len(n) for _, n in self.rows)
        if not total:
            return
        hit, spans, items = np.zeros(total, np.int64), {}, {}
        if self.parts:
            sym, doc, start, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            index = FMIndex(sym, p.sigma)
            cover = np.zeros(len(sym) + 1, np.int64)
            for block in range(0, len(p.lengths), BLOCK_WINDOWS):
                lengths = p.lengths[block : block + BLOCK_WINDOWS]
                sp, ep = index.search(p.patterns[block : block + BLOCK_WINDOWS], lengths)
                n = ep - sp
                which = np.repeat(np.arange(len(n)), n)
                if not len(which):
                    continue
                rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + sp[which]
                where = index.locate(rows)
                np.add.at(cover, where, 1)
                np.add.at(cover, where + lengths[which], -1)
                pairs = np.unique(np.stack([doc[where], which + block]), axis=1)
                for d, w in pairs.T.tolist():
                    items.setdefault(d, set()).update(p.owners[p.owner_at[w] : p.owner_at[w + 1]].tolist())
            covered = np.cumsum(cover[:-1]) > 0
            np.add.at(hit, doc[covered], 1)
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                spans.setdefault(int(doc[a]), []).append({"start": int(start[a]), "end": int(end[b - 1])})
        none = hashlib.sha256(b"").hexdigest()
        at = 0
        for ids, counts in self.rows:
            span = range(at, at + len(counts))
            own = [{p.names[k] for k in items[r]} if r in items else set() for r in span]
            names = [sorted(x - {None}) for x in own]
            n_hit = hit[at : at + len(counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(counts.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else none for x in names], pa.string()),
                    pa.array(n_hit > 0), pa.array([spans.get(r, []) for r in span], _SPANS), pa.array(names, pa.list_(pa.string())),
                ],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )
            at += len(counts)


def _phrases(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, max_benchmark_bytes: int) -> Broadcast:
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; max_benchmark_bytes is {max_benchmark_bytes}")
    return docs.sparkSession.sparkContext.broadcast(Phrases(((r[0], r[1]) for r in items.toLocalIterator()), window))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per row of docs: id, counts of words, hit words and items, the items, and the removal spans (in characters).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
    empty texts have no words and no hits; null or repeated ids are judged row by row; items without id count for hits and as one item,
    but aren't named; an item of no words, and an empty benchmark, match nothing. Other columns of docs aren't read.
    ValueError if the benchmark's texts exceed ``max_benchmark_bytes``: split it then and take the union of the spans.
    """
    phrases = _phrases(docs, benchmark, item_col, item_text_col, window, max_benchmark_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrases.value)
        for part in W.chunks(batches):
            shard.add(part.column("id"), W.split(part.column("text")))
            if shard.size >= SHARD_SYMBOLS:
                yield from shard.result()
                shard = _Shard(phrases.value)
        yield from shard.result()

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(search, f"id {ids.schema['id'].dataType.simpleString()}, {OUT}").withColumnRenamed("id", id_col)


def removed(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
            max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs without the rows that ``scan`` finds contaminated, with all columns, under any names.

    Each row is judged by itself, where it is read, whatever its id: nothing is shuffled. Null and empty texts stay, so do
    repeated rows; an empty table gives an empty result, an empty benchmark removes nothing.
    """
    phrases, place = _phrases(docs, benchmark, item_col, item_text_col, window, max_benchmark_bytes), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = _Shard(phrases.value), [], 0
        for part in W.chunks(batches, place):
            text = part.column(place)
            shard.add(pa.nulls(part.num_rows), W.split(text))
            held.append(part)
            size += text.nbytes
            if shard.size >= SHARD_SYMBOLS or size >= HELD_BYTES:
                yield from _clean(held, shard)
                shard, held, size = _Shard(phrases.value), [], 0
        yield from _clean(held, shard)

    return docs.mapInArrow(run, docs.schema)


def _clean(parts: list[pa.RecordBatch], shard: _Shard) -> Iterator[pa.RecordBatch]:
    for part, found in zip(parts, shard.result(), strict=True):
        yield part.filter(pc.invert(found.column("contaminated")))
