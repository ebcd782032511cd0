"""Duplicates, near-duplicates and contamination as exact set-similarity joins.

Sets are the character 5-grams of normalised texts. Joins run on 64-bit hashes of grams; what they find is confirmed on
the grams themselves, or counted on hashes whose chance of a clash is 1e-10 for a million different grams.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import gram_hashes, grams_of, normalize
from sparkloom.schema import EVAL_OVERLAP, NEAR_DUP
from sparkloom.streaming.cases import shared_folder

#: Grams (or items) up to which the evaluation side of a contamination join is broadcast, at some 20 bytes each; a larger side is joined by shuffle.
BROADCAST_GRAMS = 1 << 21
#: Places of a document's grams in items that are counted at once, so that memory doesn't grow with the number of items that share grams.
PLACES = 1 << 16


def exact_groups(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Groups of equal key with more than one member: key, first_id, members."""
    return rows.groupBy(key).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("members")).where("members > 1")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    best = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(best, [key, order], "left_semi")


def drop_all(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has: each copy sees the other and both go."""
    single = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)
    return rows.join(single, key, "left_semi")


def not_existing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def _grams(rows: DataFrame, id_col: str, text_col: str, side: str) -> DataFrame:
    out = rows.select(F.col(id_col).alias(f"{side}_id"), gram_hashes(normalize(F.col(text_col))).alias("g"))
    return out.select(f"{side}_id", F.size("g").alias(f"n_{side}"), "g")


class _Items:
    """The gram sets of evaluation items as postings: for each gram, ascending, the items that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in sets], np.int64)
        flat, item = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.items, self.ends = item[order].astype(np.int32), np.append(first, len(flat))

    def common(self, grams: np.ndarray) -> np.ndarray:
        """How many grams each item has in common with a set."""
        at = np.searchsorted(self.grams, grams)
        at = at[at < len(self.grams)] if not len(self.grams) else at[self.grams[np.minimum(at, len(self.grams) - 1)] == grams]
        low, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        common = np.zeros(len(self.sizes), np.int64)
        part = np.cumsum(n) // PLACES  # a part's places are fewer than PLACES and one gram's
        for first, end in itertools.pairwise(np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(n))):
            some, many = low[first:end], n[first:end]
            places = np.repeat(some - np.cumsum(many) + many, many) + np.arange(many.sum())
            common += np.bincount(self.items[places], minlength=len(common))
        return common


def _pairs(docs: DataFrame, evals: DataFrame, threshold: float, union: bool, doc_id: str, eval_id: str, text: str) -> DataFrame:
    """doc_id, item_id, common, n_doc, n_eval of pairs with common >= threshold * size of the union, or of the item.

    Either way they share that part of the item. Items of one normalised text are compared once. Whether the postings of all
    texts are small enough for a broadcast is counted first (a text has no more grams than characters); beyond that, the
    grams that the fewest items have find the candidates: a document that holds n - r + 1 of an item's n grams, or fewer,
    can't do without all of any r of them.
    """
    texts = evals.select(normalize(F.col(text)).alias("t")).where("t <> ''").distinct()
    size, n_items = texts.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    enough = lambda common, n_doc, n_eval: common >= threshold * ((n_doc + n_eval - common) if union else n_eval)
    if max(size, n_items) > BROADCAST_GRAMS:
        return _by_rare_grams(docs, evals, threshold, doc_id, eval_id, text).where(enough(F.col("common"), F.col("n_doc"), F.col("n_eval")))
    known = texts.toPandas()["t"].tolist()  # bounded by BROADCAST_GRAMS
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(_Items([grams_of(t) for t in known]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = items.value
        shortest, longest = (of.sizes[of.sizes > 0].min(), of.sizes.max()) if of.sizes.any() else (0, 0)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for k, t in enumerate(batch.column(1)):
                grams = grams_of(t.as_py())
                if union and not threshold * shortest <= len(grams) <= longest / threshold:  # similar to no item
                    continue
                common = of.common(grams)
                at = np.flatnonzero((common > 0) & enough(common, len(grams), of.sizes))
                if len(at):
                    out.append((np.full(len(at), k), at, common[at], np.full(len(at), len(grams)), of.sizes[at]))
            if out:
                row, at, common, n_doc, n_eval = (np.concatenate(x) for x in zip(*out, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, k) for x, k in zip((at, common, n_doc, n_eval), kinds, strict=True))], names)

    names = ["doc_id", "_at", "common", "n_doc", "n_eval"]
    kind = docs.schema[doc_id].dataType
    shape = T.StructType([T.StructField("doc_id", kind), *(T.StructField(x, k) for x, k in zip(names[1:], (T.IntegerType(), T.LongType(), T.IntegerType(), T.IntegerType()), strict=True))])
    pairs = docs.select(F.col(doc_id).alias("doc_id"), normalize(F.col(text)).alias("t")).mapInArrow(found, shape)
    places = spark.createDataFrame(list(enumerate(known)), "_at int, t string")
    ids = evals.select(F.col(eval_id).alias("item_id"), normalize(F.col(text)).alias("t")).join(F.broadcast(places), "t").select("_at", "item_id")
    return pairs.join(ids, "_at").select("doc_id", "item_id", "common", "n_doc", "n_eval")


def _by_rare_grams(docs: DataFrame, evals: DataFrame, threshold: float, doc_id: str, eval_id: str, text: str) -> DataFrame:
    """doc_id, item_id, common, n_doc, n_eval of all pairs where the document may hold that share of the item, by shuffles alone."""
    right, left = _grams(evals, eval_id, text, "eval").where("n_eval > 0"), _grams(docs, doc_id, text, "doc")
    grams = right.select("eval_id", "n_eval", F.explode("g").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    order = F.sort_array(F.collect_list(F.struct("df", "gram")))  # the grams of one item
    least = grams.join(counts, "gram").groupBy("eval_id", "n_eval").agg(order.alias("o"))
    need = F.greatest(F.lit(1), (F.col("n_eval") - F.ceil(F.lit(threshold) * F.col("n_eval")) + 1).cast("int"))
    least = least.select("eval_id", F.explode(F.slice("o", F.lit(1), need)).alias("x")).select("eval_id", F.col("x.gram").alias("gram"))
    found = left.select("doc_id", F.explode("g").alias("gram")).join(least, "gram").select("doc_id", "eval_id").distinct()
    full = found.join(right.select("eval_id", "n_eval", F.col("g").alias("e")), "eval_id").join(left, "doc_id")
    return full.select("doc_id", F.col("eval_id").alias("item_id"), F.size(F.array_intersect("g", "e")).cast("long").alias("common"), "n_doc", "n_eval")


def contamination(docs: DataFrame, evals: DataFrame, threshold: float = EVAL_OVERLAP, *, doc_id: str = "doc_id", eval_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs with Jaccard similarity from ``threshold`` (> 0) on: doc_id, item_id, common, n_union. Null and empty texts are in no pair."""
    out = _pairs(docs, evals, threshold, True, doc_id, eval_id, text)
    return out.select("doc_id", "item_id", "common", F.expr("n_doc + n_eval - common").alias("n_union"))


def containment(docs: DataFrame, evals: DataFrame, threshold: float = 0.9, *, doc_id: str = "doc_id", eval_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs where the document holds that share (> 0) of the item's grams: doc_id, item_id, common, n_eval."""
    return _pairs(docs, evals, threshold, False, doc_id, eval_id, text).select("doc_id", "item_id", "common", "n_eval")


def with_first(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows without the text, with first_id: the id that stands for their text in ``near_duplicates``. Texts empty after normalisation aren't in."""
    keyed = rows.withColumn("_text", F.sha2(normalize(F.coalesce(F.col(text_col), F.lit(""))), 256)).where(F.col("_text") != F.sha2(F.lit(""), 256)).drop(text_col)
    return keyed.join(keyed.groupBy("_text").agg(F.min(id_col).alias("first_id")), "_text").drop("_text")


#: Size of a set from which on bands find what is similar; smaller sets have fewer pigeonhole keys than that.
BANDED = 128
#: Bands in common that a pair needs, and the chance at most that one at the threshold has fewer.
BANDS_NEED, BANDS_MISS = 4, 1e-12
#: Classes of sizes that share one dealing into bins, and the grams of a bin, at least, in the mean.
COARSE, BIN_GRAMS = 8, 4
#: Bits of the filters by which texts are picked without a shuffle: 3 MB of broadcast words.
BITS = 1 << 23
#: Texts that share a key from which on they are compared as a crowd, and the texts of a block of one.
CROWD, BLOCK = 12, 128
#: Bytes up to which rows are spread over all cores, as a small table may be one task; texts of larger ones are read where they are.
SPREAD = 1 << 25


@lru_cache(maxsize=16)
def bands(threshold: float) -> tuple[int, int]:
    """Rows of a band and number of bands: a pair at the threshold agrees in a row with that chance, and misses BANDS_NEED bands with BANDS_MISS at most."""
    rows = max(1, round(math.log(0.27) / math.log(threshold)))
    one = threshold**rows
    return rows, next(n for n in range(BANDS_NEED, 1 << 16) if sum(math.comb(n, k) * one**k * (1 - one) ** (n - k) for k in range(BANDS_NEED)) <= BANDS_MISS)


def band_keys(grams: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """A key for each band of a set of at least that many gram hashes: the smallest hashes of its bins.

    Grams are dealt to bins by a hash, as often as it takes to have bins for all bands. In a bin the smallest hashes of two
    sets are the same with a chance of their similarity, whatever their sizes.
    """
    rows, n = bands(threshold)
    bins = max(1, min(least // BIN_GRAMS, rows * n))
    passes = np.arange(1, -(-rows * n // bins) + 1, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        h = (grams.view(np.uint64) ^ passes * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x94D049BB133111EB)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)) + (passes - np.uint64(1)) * np.uint64(bins)
        low = np.sort((place << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).ravel())
        place = low >> np.uint64(32)
        first = np.flatnonzero(np.diff(place, prepend=place[-1] + np.uint64(1)))
        least_of = np.zeros(rows * n, np.uint64)  # an empty bin stays 0
        at = place[first].astype(np.int64)
        least_of[at[at < rows * n]] = low[first][at < rows * n]
        out = np.arange(1, n + 1, dtype=np.uint64)
        for k in range(rows):
            out = (out ^ least_of[k::rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ out >> np.uint64(32)).view(np.int64)


def pigeonhole_keys(grams: np.ndarray, threshold: float) -> list[tuple[int, int, np.ndarray]]:
    """Class, need and keys of a set of gram hashes (ascending), by class of sizes.

    Two sets of Jaccard similarity from ``threshold`` on have, in some class, as many keys in common as either needs there:
    always in classes of sets below BANDED grams, but for a chance of BANDS_MISS in those of larger ones.
    """
    n, base, out = len(grams), (1 + 1e-9) / threshold, []
    own = math.floor(math.log(n) / math.log(base)) if n else -1
    for klass in range(max(0, own - 1), own + 1):
        if base**klass >= BANDED:
            coarse = klass // COARSE
            if not out or out[-1][0] != -2 - coarse:
                out.append((-2 - coarse, BANDS_NEED, band_keys(grams, math.floor(base ** (coarse * COARSE)), threshold)))
            continue
        apart = math.floor((1 - threshold) / threshold * base ** (klass + 1) + 1e-6)
        parts = apart + 1 + (apart // 5 + 4 if apart >= 20 else 0)
        part = grams.view(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts)))
        with np.errstate(over="ignore"):
            mixed = grams.view(np.uint64)[order] * np.uint64(0x94D049BB133111EB)
            whole = np.add.reduceat(mixed ^ mixed >> np.uint64(31), first) + part[order][first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(klass)
            whole *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((klass, max(1, len(first) - apart), (whole ^ whole >> np.uint64(32)).view(np.int64)))
        if len(first) <= apart:
            out.append((-1, 1, grams[: n - math.ceil(threshold * n) + 1]))
    return out


_KEYED = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("class", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Normalised texts that aren't empty, each with its smallest id."""
    texts = rows.select(F.col(id_col).alias("id"), normalize(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return texts.groupBy("text").agg(F.min("id").alias("id")).where("text <> ''")


def similarity_keys(texts: DataFrame, threshold: float = NEAR_DUP) -> DataFrame:
    """id, n, class, need, key of normalised texts (id, text): the ``pigeonhole_keys`` of each. May be stored for ``near_duplicates_with``."""

    @F.pandas_udf(_KEYED)
    def keyed(column: pd.Series) -> pd.Series:
        sets = [grams_of(t) for t in column]
        return pd.Series([[{"n": len(g), "class": c, "need": need, "keys": k} for c, need, k in pigeonhole_keys(g, threshold)] for g in sets], dtype=object)

    return texts.select("id", F.explode(keyed("text")).alias("k")).select("id", "k.n", "k.class", "k.need", F.explode("k.keys").alias("key"))


def near_duplicates_with(rows: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = NEAR_DUP, known_keys: DataFrame | None = None) -> DataFrame:
    """id and peer: every row with the smallest id of each known text, other than its own, that is similar from ``threshold`` (below 1) on.

    As ``near_duplicates``, without comparing known texts with each other. Equal texts after normalisation are similar only
    if they differ before it. known_keys: the ``similarity_keys`` of known's normalised texts by their smallest ids, if they are stored.
    """
    left, right = _texts(rows, id_col, text_col), _texts(known, id_col, text_col)
    a, b = similarity_keys(left, threshold).toDF("first_id", "n_a", "class", "need_a", "key"), (similarity_keys(right, threshold) if known_keys is None else known_keys).toDF("second_id", "n_b", "class", "need_b", "key")
    able = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    pairs = a.join(b, ["class", "key"]).where(able).groupBy("first_id", "second_id", "class").agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("need_a", "need_b")).alias("need"))
    near = _confirmed(pairs.where("shared >= need").select("first_id", "second_id").distinct(), left, right, threshold).select("first_id", F.col("second_id").alias("peer"))
    both = lambda d: d.select(F.col(id_col).alias("id"), F.sha2(normalize(F.col(text_col)), 256).alias("same"), F.sha2(text_col, 256).alias("exact"))
    kin = both(rows).join(left.select(F.sha2("text", 256).alias("same"), F.col("id").alias("first_id")), "same")
    twins = both(known).groupBy("same", "exact").agg(F.min("id").alias("peer")).withColumnRenamed("exact", "other")
    same = kin.join(twins, "same").where("exact <> other").groupBy("id").agg(F.min("peer").alias("peer"))
    return kin.join(near, "first_id").select("id", "peer").unionByName(same)


def text_ids(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """id and text: normalised texts that aren't empty, by their sha256."""
    texts = rows.select(normalize(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).where("text <> ''")
    return texts.select(F.sha2("text", 256).alias("id"), "text").groupBy("id").agg(F.first("text").alias("text"))


def _written(rows: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """written, a hash of the text as it is, text and those columns of rows whose text isn't empty after normalisation."""
    if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SPREAD:
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SPREAD:
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    some = rows.where(F.col(text_col).rlike(r"(?U)[^\s\x1c-\x1f]"))  # a filter on the normalised text would normalise it twice
    return some.select(F.xxhash64(text_col).alias("written"), F.col(text_col).alias("text"), *columns)


def _named(texts: DataFrame) -> DataFrame:
    """texts with normalised text, and its sha256 as same."""
    return texts.withColumn("text", normalize(F.col("text"))).withColumn("same", F.unhex(F.sha2("text", 256)))


def _picked(texts: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of texts with a hash among wanted (written), and few others (left_anti: those that remain), without a shuffle of texts.

    A bit for each hash is broadcast, BITS at most, however many are wanted; the more, the more others pass.
    """
    place = F.col("written").bitwiseAND(F.lit(BITS - 1))
    bits = wanted.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    words = F.broadcast(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    placed = texts.withColumn("place", place)
    there = (F.shiftright(placed.place, 6) == words.word) & F.expr("(bits & shiftleft(1L, cast(place & 63 as int))) <> 0")
    return placed.join(words, there, how).drop("place")


#: For each class of a text's set: what keys must agree in (grams, class and need; need alone for bands), and 32 bits of the keys, which hold the class.
_SIGNED = T.ArrayType(T.StructType([T.StructField("kind", T.LongType()), T.StructField("keys", T.ArrayType(T.IntegerType()))]))
#: Columns of the keys and pairs that ``near_texts_next`` goes on from.
KEYS, PAIRS = "id string, keys array<struct<kind: bigint, keys: array<int>>>", "first_id string, second_id string"


def _signature(grams: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    out = []
    for klass, need, keys in pigeonhole_keys(grams, threshold):
        with np.errstate(over="ignore"):
            mixed = (keys.view(np.uint64) ^ np.uint64((klass + (1 << 16)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
        kind = need if klass < -1 else len(grams) << 32 | klass + 2 << 16 | need
        out.append((kind, (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    return out


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def _signed(texts: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """same and keys of each different text. names: same and written of texts and n, their rows; only texts of several rows pass a shuffle."""

    @F.arrow_udf(_SIGNED)
    def keyed(column: pa.Array) -> pa.Array:
        found = [_signature(grams_of(t.as_py()), threshold) for t in column]
        flat = [x for one in found for x in one]
        keys = _lists([len(k) for _, k in flat], pa.array(np.concatenate([np.zeros(0, np.int32), *(k for _, k in flat)])))
        return _lists([len(one) for one in found], pa.StructArray.from_arrays([pa.array([kind for kind, _ in flat], pa.int64()), keys], ["kind", "keys"]))

    several = names.join(names.groupBy("same").agg(F.sum("n").alias("rows")).where("rows > 1"), "same", "left_semi").select("written")
    once, more = (_named(_picked(texts, several, how)).select("same", keyed("text").alias("keys")) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.groupBy("same").agg(F.first("keys").alias("keys")))


def _kept(df: DataFrame, kind: str) -> DataFrame:
    """df as a table of the shared folder, which goes with the application."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _who() -> Column:
    """32 bits that stand for a text while keys are joined; texts that share them are told apart afterwards."""
    return F.shiftright(F.xxhash64("same"), 32).cast("int")


def _candidates(signed: DataFrame, names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs and crowds of texts that may be similar, those that aren't fresh with fresh ones only.

    signed: same, keys, fresh; names: same, id. What is joined are 32 bits of keys and texts, as rows of keys are most of what
    is shuffled. Pairs: first_id and second_id, first_same and second_same of texts that share as many keys as they need.
    Pairs of many texts that are alike would be found by most of their keys, so a text that shares a key with CROWD - 1
    others and more gets a label, the smallest text of all such keys of it, and texts of one label are no pairs but a
    crowd: same, id, fresh, label. Pairs of two labels are found as others.
    """
    keys = signed.select(_who().alias("who"), "fresh", F.explode("keys").alias("k")).select("who", "fresh", "k.kind", F.explode("k.keys").alias("key"))
    by = Window.partitionBy("key")
    held = [F.min("who").over(by).alias("low"), F.max("who").over(by).alias("top"), F.max("fresh").over(by).alias("some"), F.count(F.lit(1)).over(by).alias("size")]
    keys = _kept(keys.select("*", *held).where("low <> top and some").select("who", "fresh", "kind", "key", "low", "size"), "shared")
    few = keys.where(F.col("size") < CROWD).select("who", "fresh", "kind", "key", F.col("who").alias("label"))
    many = keys.where(F.col("size") >= CROWD).select("who", "fresh", "kind", "key", F.min("low").over(Window.partitionBy("who")).alias("label"))
    pairs = _sharing(few, threshold).unionByName(_sharing(many, threshold)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
    pairs = pairs.where("shared >= need").select("a", "b")
    known = names.select(_who().alias("who"), "same", "id")
    labels = many.groupBy("who").agg(F.min("label").alias("label"), F.max("fresh").alias("fresh"))
    alone = known.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("who").alias("a"), F.col("who").alias("b"))
    known = known.join(labels, "who", "left")
    a, b = known.select("who", "same", "id", "label").toDF("a", "same_a", "id_a", "label_a"), known.select("who", "same", "id", "label").toDF("b", "same_b", "id_b", "label_b")
    pairs = pairs.unionByName(alone).join(a, "a").join(b, "b").where("id_a <> id_b and (a <> b or id_a < id_b) and (label_a = label_b) is not true")
    pairs = pairs.select(F.least("id_a", "id_b").alias("first_id"), F.greatest("id_a", "id_b").alias("second_id"), F.col("same_a").alias("first_same"), F.col("same_b").alias("second_same"))
    return _kept(pairs, "candidates"), _kept(known.where("label is not null").select("same", "id", "fresh", "label"), "crowds")


def _sharing(keys: DataFrame, threshold: float) -> DataFrame:
    """a, b and need for each key that two texts of different labels share."""
    columns = ("who", "fresh", "kind", "label", "key")
    a, b = (keys.select(*columns).toDF(side, *(f"{x}_{side}" for x in columns[1:4]), "key") for side in "ab")
    n = lambda side: F.shiftright(f"kind_{side}", 32)
    alike = F.expr("a < b and label_a <> label_b and (fresh_a or fresh_b) and (kind_a & 4294901760) = (kind_b & 4294901760)")
    pairs = a.join(b, "key").where(alike & (F.least(n("a"), n("b")) >= F.lit(threshold) * F.greatest(n("a"), n("b"))))
    return pairs.select("a", "b", F.greatest(F.expr("kind_a & 65535"), F.expr("kind_b & 65535")).alias("need"))


def near_texts_next(rows: DataFrame, keys: DataFrame, pairs: DataFrame, *, text_col: str = "text", threshold: float = NEAR_DUP) -> tuple[DataFrame, DataFrame]:
    """keys and pairs (first_id, second_id) of the different texts of rows, by ``text_ids``, from those of earlier rows.

    Only texts without keys are compared, with each other and with the rest in one join; the keys and pairs of texts that
    rows don't have any more go. Start with empty ones of KEYS and PAIRS. Keys of another form, as earlier versions stored
    them, are made anew, and so are their pairs. The new keys and candidates are tables in the shared folder.
    """
    if keys.columns != ["id", "keys"]:
        keys, pairs = rows.sparkSession.createDataFrame([], KEYS), pairs.limit(0)
    texts = _written(rows, text_col)
    names = _kept(_named(texts).groupBy("same", "written").agg(F.count(F.lit(1)).alias("n")), "names").withColumn("id", F.lower(F.hex("same")))
    fresh = names.join(keys.select("id"), "id", "left_anti")
    added = _signed(_picked(texts, fresh), names, threshold).join(fresh.select("same"), "same", "left_semi")
    added = _kept(added.select(F.lower(F.hex("same")).alias("id"), "keys"), "keys")
    kept = keys.join(names.select("id"), "id", "left_semi").select("id", "keys")
    signed = kept.withColumn("fresh", F.lit(False)).unionByName(added.withColumn("fresh", F.lit(True))).select(F.unhex("id").alias("same"), "keys", "fresh")
    found = _confirmed_in(texts, names, *_candidates(signed, signed.select("same", F.lower(F.hex("same")).alias("id")), threshold), threshold)
    left = pairs.join(names.select(F.col("id").alias("first_id")), "first_id", "left_semi").join(names.select(F.col("id").alias("second_id")), "second_id", "left_semi")
    return kept.unionByName(added), left.select("first_id", "second_id").unionByName(found.select("first_id", "second_id"))


def near_duplicates(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = NEAR_DUP) -> DataFrame:
    """Pairs of different normalised texts with Jaccard similarity from ``threshold`` (below 1) on: first_id, second_id, common, n_union.

    Equal texts are represented by their smallest id; ``with_first`` names it for every row. Sizes fall into classes by
    powers of 1 / t; a set is dealt once as the smaller one and once as the larger one of a pair. Candidates of small sets
    by the pigeonhole principle: sets of n and more grams that similar differ in at most H = (1 - t) / t n grams. Grams are
    dealt to some 1.2 H parts by hash, so all but H of a set's parts are the same in both; the hash of a whole part (some
    five grams) is the join key, and a pair must share as many keys. A set with no more than H parts that aren't empty (a
    very small one) joins others of that kind by a prefix filter in the order of hashes. Sets from BANDED grams on would
    have a key for every sixth gram and share some with most others; they have a fixed number of ``band_keys`` instead,
    which lose a pair with a chance of 1e-12. Candidates, which are found at once and kept in the shared folder, are compared
    by all their grams. Texts are shuffled only if they are in one.
    """
    texts = _written(rows, text_col, F.col(id_col).alias("id"))
    names = _kept(_named(texts).groupBy("same", "written").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "names")
    signed = _signed(texts, names, threshold).withColumn("fresh", F.lit(True))
    ids = names.groupBy("same").agg(F.min("id").alias("id"))
    return _confirmed_in(texts, names, *_candidates(signed, ids, threshold), threshold)


#: Texts pass shuffles in this form, in two thirds of what they take there otherwise.
_CODEC = "zstd"
#: Grams of texts that are remembered while candidates are compared, as a text is in several of them.
REMEMBERED = 1 << 21


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    codec = pa.Codec(_CODEC, 3)
    raw = [t.as_py().encode() for t in texts]
    return pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())


def _unpacked(text: bytes) -> str:
    return pa.Codec(_CODEC).decompress(text[8:], int.from_bytes(text[:8], "little"), asbytes=True).decode()


def _confirmed_in(texts: DataFrame, names: DataFrame, pairs: DataFrame, crowds: DataFrame, threshold: float) -> DataFrame:
    """first_id, second_id, common and n_union of those candidates that are similar. texts: written, text; names: same, written."""
    wanted = pairs.select(F.explode(F.array("first_same", "second_same")).alias("same")).unionByName(crowds.select("same")).distinct()
    places = names.groupBy("same").agg(F.min("written").alias("written")).join(wanted, "same", "left_semi")  # one way of writing each
    some = _named(_picked(texts, places)).select("same", _packed("text").alias("text")).groupBy("same").agg(F.first("text").alias("text"))
    full = pairs.join(some.toDF("first_same", "text_a"), "first_same").join(some.toDF("second_same", "text_b"), "second_same")
    out = full.select("first_id", "second_id", _common_packed("text_a", "text_b").alias("c")).select("first_id", "second_id", "c.common", "c.n_union")
    return out.where(F.col("common") >= F.lit(threshold) * F.col("n_union")).unionByName(_in_crowds(crowds, some, threshold))


def _in_crowds(crowds: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """first_id, second_id, common and n_union of similar texts of one label, compared block by block, so that a text moves once for each block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sized = crowds.join(crowds.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "label")
    own = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("same", "id", "fresh", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(texts, "same")
    kind = crowds.schema["id"].dataType

    def compared(table: pa.Table) -> pa.Table:
        own, fresh, least = (np.array(table.column(c)) for c in ("own", "fresh", "x"))
        sets = [grams_of(_unpacked(t.as_py())) for t in table.column("text")]
        second = np.flatnonzero(own == table.column("y")[0].as_py())
        items, one = _Items([sets[k] for k in second]), own[0] == least[0] and (own == own[0]).all()
        out = [np.zeros((0, 4), np.int64)]
        for k in np.flatnonzero(own == least):
            common = items.common(sets[k])
            union = len(sets[k]) + items.sizes - common
            at = np.flatnonzero((common >= threshold * union) & (fresh[k] | fresh[second]) & ((second > k) if one else True))
            out.append(np.stack([np.full(len(at), k), second[at], common[at], union[at]], 1))
        a, b, common, union = np.concatenate(out).T
        ids = table.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(common), pa.array(union)], ["a", "b", "common", "n_union"])

    shape = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("common", T.LongType()), T.StructField("n_union", T.LongType())])
    found = dealt.select("id", "fresh", "label", "own", "x", "y", "text").groupBy("label", "x", "y").applyInArrow(compared, shape)
    return found.select(F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id"), "common", "n_union")


_COMMON = T.StructType([T.StructField("common", T.LongType()), T.StructField("n_union", T.LongType())])


@F.pandas_udf(_COMMON)
def _in_common(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Grams of two normalised texts in common, and of either."""
    sets = [(grams_of(x), grams_of(y)) for x, y in zip(a, b, strict=True)]
    common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], np.int64)
    return pd.DataFrame({"common": common, "n_union": np.array([len(x) + len(y) for x, y in sets], np.int64) - common})


class _Grams:
    """``grams_of`` packed texts, with the last REMEMBERED grams at least."""

    def __init__(self) -> None:
        self.sets: dict[bytes, np.ndarray] = {}
        self.total = 0

    def __call__(self, text: bytes) -> np.ndarray:
        found = self.sets.pop(text, None)
        if found is None:
            found = grams_of(_unpacked(text))
            self.total += len(found)
            while self.sets and self.total > REMEMBERED:
                self.total -= len(self.sets.pop(next(iter(self.sets))))
        self.sets[text] = found
        return found


@F.arrow_udf(_COMMON)
def _common_packed(a: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    grams = _Grams()
    for some, others in a:
        sets = ((grams(x.as_py()), grams(y.as_py())) for x, y in zip(some, others, strict=True))
        common, either = zip(*((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in sets), strict=True) if len(some) else ((), ())
        common = np.array(common, np.int64)
        yield pa.StructArray.from_arrays([pa.array(common), pa.array(np.array(either, np.int64) - common)], ["common", "n_union"])


def _confirmed(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    full = pairs.join(left.select(F.col("text").alias("text_a"), F.col("id").alias("first_id")), "first_id").join(right.select(F.col("text").alias("text_b"), F.col("id").alias("second_id")), "second_id").where("text_a <> text_b")
    out = full.select("first_id", "second_id", _in_common("text_a", "text_b").alias("c")).select("first_id", "second_id", "c.common", "c.n_union")
    return out.where(F.col("common") >= F.lit(threshold) * F.col("n_union"))
