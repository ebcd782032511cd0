"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual subspace codes, exact rerank.

Vectors are scaled to length 1; cosine >= t is then distance <= r = sqrt(2 - 2t). A coarse k-means deals every vector to
the list of its nearest centroid, and codebooks of subspaces encode its residual; its reconstruction error is kept.

Probes are sufficient by geometry: vectors of two lists stand on either side of the plane halfway between the centroids,
so for neighbours the distances of both to that plane add up to r at most, and one of them is r / 2 at most. That one
asks in the other's list; all other lists are passed over without loss. In a list, distances come from lookup tables
(asymmetric: q isn't quantised), first over half of the subspaces. A vector whose table distance less its own
reconstruction error is above r can't be a neighbour; the others are reranked by exact cosine in double precision. So the
fit on a sample decides speed, never the result. A link found from one side only counts for both; a link of which both
ends ask is found from both, and each counts its own.

Equal vectors of a label are one node with a count. A list is dealt out in blocks of bounded size by hash, for the listed
and for the asking side, so no task holds a whole list; tasks send sums and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components, local_roots
from sparkloom.llm.store import kept, scope

THRESHOLD = 0.93
#: The index is fitted on so many distinct vectors at most, the first by a hash of the vector; it has one list for each
#: FIT_SHARE of them at most. Every vector is indexed.
FIT_ROWS, FIT_SHARE = 1 << 16, 16
#: Codebooks are fitted on so many residuals of these at most.
BOOK_ROWS = 8192
SUB_DIM, CODES = 4, 256
#: Vectors of a block, about; and of a list, for the number of lists.
BLOCK = 1024
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's method from k rows of x; an empty one is put on the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near, d = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-d)[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[at : at + 4096] @ c.T
        out[at : at + 4096] = d.argmin(1)
        dist[at : at + 4096] = d.min(1) + (x[at : at + 4096] ** 2).sum(1)
    return out, dist


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        """sample: unit vectors, one a row; may be empty. Lists are fewer where the sample is small."""
        lists = max(1, min(lists, len(sample) // FIT_SHARE))
        dim = sample.shape[1]
        self.sub = max(1, math.ceil(dim / SUB_DIM))
        self.dim = self.sub * SUB_DIM
        sample = self.padded(sample)
        self.coarse = kmeans(sample, lists) if len(sample) else np.zeros((1, self.dim))
        part = sample[:BOOK_ROWS]
        residual = part - self.coarse[nearest(part, self.coarse)[0]] if len(part) else part
        books = [kmeans(residual[:, m * SUB_DIM : (m + 1) * SUB_DIM], CODES, seed=m) if len(sample) else np.zeros((1, SUB_DIM)) for m in range(self.sub)]
        size = max(map(len, books))
        self.books = np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), 0)]) for b in books])
        # row by row, so that no more than one list's differences are in memory; rounded up, which only adds probes
        self.between = np.empty((len(self.coarse), len(self.coarse)), np.float32)
        for k, c in enumerate(self.coarse):
            d = np.sqrt(((self.coarse - c) ** 2).sum(1))
            self.between[k] = np.nextafter(np.where(d > 0, d, np.inf).astype(np.float32), np.float32(np.inf))

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Vectors with zeros up to the quantiser's dimension; longer ones lose their tail, which only loosens bounds."""
        out = np.zeros((len(x), self.dim))
        out[:, : min(self.dim, x.shape[1])] = x[:, : self.dim]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and reconstruction error of padded vectors."""
        at, _ = nearest(x, self.coarse)
        residual = x - self.coarse[at]
        codes = np.empty((len(x), self.sub), np.uint8)
        error = np.zeros(len(x))
        for m in range(self.sub):
            part = residual[:, m * SUB_DIM : (m + 1) * SUB_DIM]
            codes[:, m], _ = nearest(part, self.books[m])
            error += ((part - self.books[m][codes[:, m]]) ** 2).sum(1)
        return at, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
        """In which lists each padded vector asks for neighbours within radius (rows: vectors, columns: lists)."""
        d2 = np.maximum(0, (x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T)
        over = (d2 - d2[np.arange(len(x)), at][:, None]) / (2 * self.between[at])
        return over <= radius / 2 + _SLACK

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """Squared distances from each q's residual to each code of each subspace (subspaces first)."""
        r = (q - self.coarse[at]).reshape(len(q), self.sub, SUB_DIM).transpose(1, 0, 2)
        d = (r**2).sum(2)[:, :, None] - 2 * r @ self.books.transpose(0, 2, 1) + (self.books**2).sum(2)[:, None]
        return np.maximum(d, 0).astype(np.float32)


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    for v in batch.column("vector"):
        if not v.is_valid or v.values.null_count:
            yield None
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        yield x if len(x) and np.isfinite(x).all() and x.any() else None


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds node, a digest of label and vector; null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            nodes = [None if x is None or k is None else xxhash.xxh3_128_digest(k.encode() + b"\0" + x.tobytes()) for x, k in zip(_rows(batch), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "node"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, node binary")


def _bytes(v: np.ndarray) -> bytes:
    """A vector in single precision if that loses nothing; the kind of a list tells which."""
    return v.tobytes() if _doubles(v) else v.astype(np.float32).tobytes()


def _doubles(v: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return bool((v.astype(np.float32) != v).any())


def _column(rows: pa.Array, name: str, kind: type) -> np.ndarray:
    """A field of binary values of one length as a matrix."""
    data = rows.field(name)
    data = data.slice(0) if not data.offset else pa.concat_arrays([data])
    ends = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(data), -1)


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id (smallest id that links reach), kept (is that id).

    Rows link if their labels are equal and not null, their vectors have the same length, and the cosine in double
    precision is at least ``threshold`` (> 0). Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Repeated ids are rows of their own that share an id; a null id never is a component_id unless the
    component has no other. Other columns aren't read; an empty table gives an empty result.
    """
    with scope(rows.sparkSession) as stay:
        source, classes = _classes(rows, id_col, vector_col, label_col, threshold, block, fit_rows)
        stay += [source, classes]
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return source.select("id", "node").join(classes, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _classes(rows: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, block: int, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their nodes, and component_id and n_links of each node."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    source = kept(_keyed(rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))), "vectors")
    nodes = source.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = kept(nodes, "nodes")
    vectors = source.select("node", "label", "vector", "id").join(nodes.withColumnRenamed("id", "first"), "node")
    vectors = vectors.where(F.col("id").eqNullSafe(F.col("first"))).select("node", "label", "vector", "copies").distinct()
    vectors = kept(vectors, "distinct")
    n, largest = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    sample = [np.array(r[0], np.float64) for r in vectors.orderBy("node").limit(fit_rows).select("vector").toLocalIterator()]
    dims = [len(x) for x in sample]
    dim = max(set(dims), key=dims.count) if dims else 1
    sample = [x / np.linalg.norm(x) for x in sample if len(x) == dim]
    pq = Quantiser(np.stack(sample) if sample else np.zeros((0, 1)), max(4, min(math.isqrt(n), largest // block)))
    shared = rows.sparkSession.sparkContext.broadcast(pq)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, min(2048, whole.num_rows - at))
                raw = list(_rows(batch))
                x = np.concatenate([pq.padded((v / np.linalg.norm(v))[None]) for v in raw]) if raw else np.zeros((0, pq.dim))
                lists, codes, error = pq.encode(x)
                probes = pq.probes(x, lists, radius)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node"), pa.array([f"{len(v)} {int(_doubles(v))} {k}" for v, k in zip(raw, batch.column("label").to_pylist(), strict=True)]), batch.column("copies"),
                        pa.array([_bytes(v) for v in raw], pa.binary()), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error), pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32())), pa.array([p.tobytes() for p in np.packbits(probes, axis=1)], pa.binary()),
                    ],
                    ["node", "kind", "copies", "raw", "list", "codes", "error", "probes", "asks"],
                )

    indexed = kept(vectors.mapInArrow(index, "node binary, kind string, copies long, raw binary, list int, codes binary, error double, probes array<int>, asks binary"), "index")
    # blocks of each list: as many as its size asks for on either side
    listed = indexed.groupBy("kind", "list").agg(F.count(F.lit(1)).alias("n_x"))
    asking = indexed.select("kind", F.explode("probes").alias("list")).groupBy("kind", "list").agg(F.count(F.lit(1)).alias("n_q"))
    sizes = listed.join(asking, ["kind", "list"]).select("kind", "list", F.ceil(F.col("n_x") / block).alias("bx"), F.ceil(F.col("n_q") / block).alias("bq"))
    sizes = kept(sizes, "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("bx")).cast("long")
    mine = F.pmod(F.xxhash64("node"), F.col("bq")).cast("long")
    keys = ["kind", "list", "x", "q"]
    xs = indexed.select("kind", "list", "node", "copies", "raw", "codes", "error", "asks").join(sizes, ["kind", "list"])
    xs = xs.groupBy("kind", "list", own.alias("x"), "bq").agg(F.collect_list(F.struct("node", "copies", "raw", "codes", "error", "asks")).alias("xs"))
    xs = xs.select("kind", "list", "x", F.explode(F.sequence(F.lit(0), F.col("bq") - 1)).alias("q"), "xs")
    qs = indexed.select("kind", F.explode("probes").alias("list"), "node", "copies", "raw", F.col("list").alias("home")).join(sizes, ["kind", "list"])
    qs = qs.groupBy("kind", "list", mine.alias("q"), "bx").agg(F.collect_list(F.struct("node", "copies", "raw", "home")).alias("qs"))
    qs = qs.select("kind", "list", "q", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("x"), "qs")
    pairs = xs.join(qs, keys).select("kind", "list", "xs", "qs")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                kind = np.float64 if batch.column("kind")[k].as_py().split(" ", 2)[1] == "1" else np.float32
                found = _linked(pq, batch.column("list")[k].as_py(), batch.column("xs")[k].values, batch.column("qs")[k].values, kind, radius, threshold)
                if found:
                    u, n, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(n, pa.int64()), pa.array(v, pa.binary())], ["u", "n", "v"])

    found = kept(pairs.mapInArrow(rerank, "u binary, n long, v binary"), "links")
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "node")
    root = components(found.select("u", "v"))
    grouped = nodes.join(root, "node", "left").join(counts, "node", "left").select("node", "id", "copies", "n", F.coalesce("root", "node").alias("root"))
    grouped = kept(grouped, "grouped")
    low = kept(grouped.groupBy("root").agg(F.min("id").alias("component_id")), "low")
    classes = grouped.join(low, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return source, kept(classes, "classes")


def _linked(pq: Quantiser, at: int, xs: pa.StructArray, qs: pa.StructArray, kind: type, radius: float, threshold: float) -> list[tuple[bytes, int, bytes]]:
    """Of one block of listed and one of asking nodes: (node, rows it links to as far as this block counts them, a node of its local component)."""
    x, q = _column(xs, "raw", kind), _column(qs, "raw", kind)
    nx, nq = (np.linalg.norm(v.astype(np.float64), axis=1) for v in (x, q))
    unit = pq.padded(q / nq[:, None])
    codes = np.ascontiguousarray(_column(xs, "codes", np.uint8).T).astype(np.intp)
    limit = ((xs.field("error").to_numpy() + radius) ** 2 * (1 + 1e-4) + _SLACK).astype(np.float32)
    asks, home = np.unpackbits(_column(xs, "asks", np.uint8), axis=1), qs.field("home").to_numpy()
    copies, weights = xs.field("copies").to_numpy(), qs.field("copies").to_numpy()
    both = np.concatenate([_column(xs, "node", np.uint64), _column(qs, "node", np.uint64)])
    names, number = np.unique(both, axis=0, return_inverse=True)
    ix, iq = number[: len(xs)], number[len(xs) :]
    n, us, vs = np.zeros(len(names), np.int64), [], []
    half = pq.sub // 2
    for a in range(0, len(q), 128):
        tables = pq.tables(unit[a : a + 128], at)
        d2 = np.zeros((tables.shape[1], len(x)), np.float32)
        for m in range(half):
            d2 += tables[m].take(codes[m], axis=1)
        i, j = np.nonzero(d2 <= limit)
        d = d2[i, j]
        for m in range(half, pq.sub):
            d += tables[m][i, codes[m][j]]
        some = (d <= limit[j]) & (iq[i + a] != ix[j])
        i, j = i[some] + a, j[some]
        for b in range(0, len(i), 1 << 15):
            ii, jj = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
            near = np.einsum("ij,ij->i", q[ii].astype(np.float64), x[jj].astype(np.float64)) / (nq[ii] * nx[jj]) >= threshold
            ii, jj = ii[near], jj[near]
            np.add.at(n, iq[ii], copies[jj])
            alone = asks[jj, home[ii]] == 0  # the listed end doesn't ask in the other's list
            np.add.at(n, ix[jj[alone]], weights[ii[alone]])
            us.append(iq[ii])
            vs.append(ix[jj])
    if not us or not sum(map(len, us)):
        return []
    root = local_roots(np.concatenate(us), np.concatenate(vs), len(names))
    name = [x.tobytes() for x in names]
    return [(name[k], int(n[k]), name[r]) for k, r in enumerate(root.tolist()) if n[k] or r != k]
