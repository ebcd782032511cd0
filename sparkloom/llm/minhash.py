"""Near-duplicates by BagMinHash: weighted Jaccard similarity of the multisets of five-word shingles.

Signatures. Every shingle with multiplicity w owns the weight levels 1..w. The levels are split into dyadic intervals
[0,1), [1,2), [2,4), ...; each interval is a Poisson process of points in time whose rate is its width, and each point
carries a level inside the interval, drawn uniformly, and one of the registers. Points above w don't count. (The same points
as a tree of processes split in halves gives, without the tree: all points of an interval are made, and levels at once.) A register keeps its earliest point, so two multisets agree in a register with probability equal to their
weighted Jaccard similarity. Points are made in ascending time and a process ends at its text's latest register, so the
work for a text is about its shingles plus m log m points.

Search. Texts of equal words are one node (128-bit digest), found by a partial aggregate. Nodes that share a band meet at
the band's centre (the node that meets most others), never pairwise; those pairs are verified on whole texts. What bands
still connect in different components is then compared across components, block by block, so no link that the bands show
is lost and most members of a group of near copies cost one comparison. With 32 bands of 5 registers a link at similarity 0.8 is missed with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.components import components
from sparkloom.llm.store import kept, scope, with_row_key

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: Nodes of a block of the comparison across components, about.
BLOCK = 256
SEED = 0x5DEECE66D
_U = np.uint64
#: The column of the row keys beside those of the documents.
_KEY = "_near_row"


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash signature (float64 times) of each row's multiset; infinite where a row has no elements.

    doc, value, weight: the distinct elements with their multiplicities, as ``words.bag`` gives them.
    """
    sig = np.full(n_docs * registers, np.inf)
    level = np.zeros(len(doc), np.int64)
    blocks = []
    while True:  # block k starts at 0, 1, 2, 4, ...
        low = 0 if not len(blocks) else 1 << (len(blocks) - 1)
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        blocks.append((at, np.full(len(at), low, np.int64), np.full(len(at), max(1, low), np.int64)))
    if not blocks:
        return sig.reshape(n_docs, registers)
    at, low, width = (np.concatenate(x) for x in zip(*blocks, strict=True))
    doc, weight = doc[at], weight[at]
    state = W.mix(value[at] ^ W.mix(low.astype(_U) + _U(SEED)))
    time = np.zeros(len(at))
    while len(state):
        state = W.mix(state)
        time = time - np.log((state >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
        inner = W.mix(state ^ _U(0xA5A5A5A5A5A5A5A5))
        register = ((inner >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        level = low + ((inner & _U(0xFFFFFFFF)) * width.astype(_U) >> _U(32)).astype(np.int64)
        inside = level < weight
        np.minimum.at(sig, doc[inside] * registers + register[inside], time[inside])
        last = sig.reshape(n_docs, registers).max(axis=1)
        go = time < last[doc]
        state, time, doc, weight, low, width = state[go], time[go], doc[go], weight[go], low[go], width[go]
    return sig.reshape(n_docs, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    bits = sig[:, : bands * rows].copy().view(np.uint64).reshape(len(sig), bands, rows)
    key = W.mix(np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands)))
    for k in range(rows):
        key = W.mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def node_keys(words: W.Words) -> list[bytes]:
    """A digest of each row's words; of its bytes where it has none."""
    raw = words.hash.tobytes()
    first = (words.first * 8).tolist()
    out = []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        data = raw[a:b] if b > a else b"\0" + words.data[words.offsets[k] : words.offsets[k + 1]].tobytes()
        out.append(xxhash.xxh3_128_digest(data))
    return out


class Bags:
    """The multisets of a column of texts, rows ascending: doc, value, weight; first of each row, and total weight."""

    def __init__(self, text: pa.Array, size: int):
        doc, value, weight, done = [], [], [], 0
        for part in W.chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
            words = W.split(part.column("text"))
            d, v, w = W.bag(words, size)
            doc.append(d + done)
            value.append(v)
            weight.append(w)
            done += part.num_rows
        self.doc, self.value = np.concatenate([np.empty(0, np.int64), *doc]), np.concatenate([np.empty(0, _U), *value])
        self.weight = np.concatenate([np.empty(0, np.int64), *weight])
        self.first = np.searchsorted(self.doc, np.arange(done + 1))
        self.total = np.bincount(self.doc, weights=self.weight, minlength=done)

    def common(self, other: Bags) -> np.ndarray:
        """The weight that each row shares with the other's row of the same place."""
        doc, value, weight = (np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("doc", "value", "weight"))
        order = np.lexsort((value, doc))
        doc, value, weight = doc[order], value[order], weight[order]
        at = np.flatnonzero((doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))
        return np.bincount(doc[at], weights=np.minimum(weight[at], weight[at + 1]), minlength=len(self.total))


def alike(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of multisets of total weights a and b; 0 where both are empty."""
    return common / np.maximum(a + b - common, 1)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, key_col: str) -> DataFrame:
    """id, node, n (shingles), keys (one for each band; none for a text without words) and row_key. A null text has no node."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(key_col).alias("row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            text = part.column("text")
            words = W.split(text)
            doc, value, weight = W.bag(words, size)
            sig = signatures(doc, value, weight, part.num_rows, bands * rows)
            n = np.bincount(doc, weights=weight, minlength=part.num_rows).astype(np.int64)
            keys = band_keys(sig, bands, rows)
            full = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel()))
            missing = text.is_null().to_numpy(zero_copy_only=False)
            nodes = pa.array([None if m else k for k, m in zip(node_keys(words), missing, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), nodes, pa.array(n), lists, part.column("row_key")], ["id", "node", "n", "keys", "row_key"])

    kinds = [source.schema[x].dataType.simpleString() for x in ("id", "row_key")]
    return source.mapInArrow(run, f"id {kinds[0]}, node binary, n long, keys array<long>, row_key {kinds[1]}")


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are similar enough."""
    left = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = left.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, column="text_v"):
            a, b = (Bags(part.column("text_" + x), size) for x in "uv")
            yield part.select(["u", "v"]).filter(pa.array(alike(a.common(b), a.total, b.total) >= threshold))

    return both.mapInArrow(run, "u binary, v binary").distinct()


def across(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between the roots of one cluster, of nodes that are similar enough; rows: cluster, node, n, root, keys, text.

    Each node outside a cluster's largest root is compared with every node of another root that shares a band, in a grid
    of blocks: a task holds two blocks and sends a spanning forest of what links there, not pairs.
    """
    counts = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("roots"))
    tops = tops.where("roots > 1").select("cluster", F.col("top.root").alias("main"), F.ceil(F.col("all") / BLOCK).alias("bx"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).alias("bq"))
    split = kept(rows.join(kept(tops, "tops"), "cluster"), "cluster-rows")
    one = F.collect_list(F.struct("node", "n", "root", "keys", "text"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("long")
    xs = split.groupBy("cluster", place("bx").alias("x"), "bq").agg(one.alias("xs"))
    xs = xs.select("cluster", "x", F.explode(F.sequence(F.lit(0), F.col("bq") - 1)).alias("q"), "xs")
    qs = split.where("root != main").groupBy("cluster", place("bq").alias("q"), "bx").agg(one.alias("qs"))
    qs = qs.select("cluster", "q", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("x"), "qs")
    grid = xs.join(qs, ["cluster", "x", "q"]).select("xs", "qs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _across(batch.column("xs")[k].as_py(), batch.column("qs")[k].as_py(), size, threshold)
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return grid.mapInArrow(run, "u binary, v binary")


def _across(xs: list[dict], qs: list[dict], size: int, threshold: float) -> list[tuple[bytes, bytes]]:
    nx, nq = np.array([r["n"] for r in xs]), np.array([r["n"] for r in qs])
    kx, kq = np.array([r["keys"] for r in xs]), np.array([r["keys"] for r in qs])
    roots: dict[bytes, int] = {}
    rx = np.array([roots.setdefault(r["root"], len(roots)) for r in xs])
    rq = np.array([roots.setdefault(r["root"], len(roots)) for r in qs])
    bx, bq = (Bags(pa.array([r["text"] for r in rows], pa.string()), size) for rows in (xs, qs))
    order = np.argsort(bx.value, kind="stable")  # postings: which rows have a shingle, and how often
    post, row, times = bx.value[order], bx.doc[order], bx.weight[order]
    names = list(roots)
    group = np.arange(len(roots))  # roots that links of this block have joined
    out = []
    for k in range(len(qs)):
        able = (group[rx] != group[rq[k]]) & (np.minimum(nx, nq[k]) >= threshold * np.maximum(nx, nq[k])) & (kx == kq[k]).any(axis=1)
        if not able.any():
            continue
        mine = slice(bq.first[k], bq.first[k + 1])
        low, high = np.searchsorted(post, bq.value[mine], "left"), np.searchsorted(post, bq.value[mine], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(row[at], weights=np.minimum(times[at], np.repeat(bq.weight[mine], n)), minlength=len(xs))
        for j in np.flatnonzero(able & (alike(common, bx.total, bq.total[k]) >= threshold)).tolist():
            if group[rx[j]] != group[rq[k]]:
                out.append((names[rq[k]], names[rx[j]]))
                group[group == group[rx[j]]] = group[rq[k]]
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, component_id (smallest id of its group) and kept (whether it is the group's one kept row).

    Texts are linked from weighted Jaccard similarity ``threshold`` on; groups are what links reach. Fewer than ``size``
    words are one shingle. Texts with the same words are one node; texts without words only match equal ones; null texts
    stay alone and are kept. Of rows that repeat the smallest id one is kept; null ids come after all others, and a group whose
    ids are all null has a null component_id. Other columns aren't read; an empty table gives an empty result.
    """
    found = _judged(with_row_key(docs, _KEY), id_col, text_col, size, threshold, bands, rows)
    return found.select(F.col("id").alias(id_col), "component_id", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """id, row_key, component_id and kept of each row of docs, which has a column _KEY."""
    with scope(docs.sparkSession) as stay:
        rows_ = kept(sketch(docs, id_col, text_col, size, bands, rows, _KEY), "sketch")
        classes = _classes(rows_, docs, text_col, size, threshold)
        stay += [rows_, classes]
    return rows_.drop("n", "keys").join(classes, "node", "left").select(
        "id", "row_key",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        F.coalesce(F.col("best.row_key") == F.col("row_key"), F.lit(True)).alias("kept"),
    )


def _classes(rows: DataFrame, docs: DataFrame, text_col: str, size: int, threshold: float) -> DataFrame:
    """node and best, the first row (by id, nulls last) of its group."""
    # the first row of a node stands for it: its sketch and its text are the node's
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key")).alias("best")
    nodes = kept(rows.where("node is not null").groupBy("node").agg(first, F.max("n").alias("n")), "nodes")
    keyed = rows.where("size(keys) > 0").select("node", "row_key", "keys")
    firsts = kept(keyed.join(nodes.select("node", "n", F.col("best.row_key").alias("first")), "node").where("row_key = first").select("node", "row_key", "n", "keys"), "firsts")
    exploded = firsts.select("node", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.count(F.lit(1)).alias("held")).where("low != top")
    members = kept(exploded.join(kept(shared.select("key", "held"), "bands"), "key"), "members")
    degree = kept(members.groupBy("node").agg(F.sum("held").alias("degree")), "degrees")
    ranked = kept(members.join(degree, "node").select("key", "node", "degree"), "ranked")
    centre = kept(ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("c")).select("key", F.col("c.node").alias("u")), "centres")
    star = kept(ranked.join(centre, "key").where("node != u").select("u", F.col("node").alias("v")).distinct(), "star")
    wanted = firsts.join(degree.select("node"), "node", "left_semi").select("node", "row_key")
    texts = kept(docs.select(F.col(_KEY).alias("row_key"), F.col(text_col).alias("text")).join(wanted, "row_key").select("node", "text"), "texts")
    sized = firsts.select("node", "n")
    pairs = star.join(sized.toDF("u", "n_u"), "u").join(sized.toDF("v", "n_v"), "v").where(F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v"))
    links = kept(verified(pairs.select("u", "v"), texts, size, threshold), "verified")
    named = degree.join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = kept(named, "named")
    # what bands connect but links don't, as a graph of roots: its components are the clusters to compare across
    of = lambda x: named.select(F.col("node").alias(x), F.col("root").alias("root_" + x))
    between = star.join(of("u"), "u").join(of("v"), "v").where("root_u != root_v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    cluster = components(between).toDF("root", "cluster")
    rest = named.join(cluster, "root").join(firsts, "node").join(texts, "node")
    more = kept(across(kept(rest.select("cluster", "node", "n", "root", "keys", "text"), "rest"), size, threshold), "across")
    top = components(more).toDF("root", "top")
    named = named.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    grouped = kept(nodes.join(named, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root")), "grouped")
    best = kept(grouped.groupBy("root").agg(F.min("best").alias("best")), "groups")
    return kept(grouped.drop("best").join(best, "root").select("node", "best"), "classes")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with the kept row of each group of near-duplicates: of its smallest id, nulls last. Null texts all stay.

    Rows are told apart by a key of their own, so ids may be null or repeat, and whole rows may too; all columns stay.
    """
    keyed = with_row_key(docs, _KEY)
    best = _judged(keyed, id_col, text_col, size, threshold, bands, rows).where("kept").select(F.col("row_key").alias(_KEY))
    return keyed.join(best, _KEY, "left_semi").drop(_KEY)
