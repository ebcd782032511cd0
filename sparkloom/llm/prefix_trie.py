"""The trie of conversation prefixes, built level by level: which turns many conversations share, and what sharing them saves.

Construction. At each depth the live conversations are grouped by (node, next turn); a group is a node of the next depth and
its smallest conv_id names it. A node whose conversations are the same to their ends (one alone, or copies of one text) is
settled: below it is a chain that needs no more levels, so levels end where conversations have all parted. Turns are compared
by the SHA-256 of role and text; that conversations are the same to their ends by a 128-bit sum of those.

Roll-up. From the deepest level to the root, children are joined to their parents and bring leaves and savings along.

Nothing is collected by key: groups are partial aggregates, memberships are joined back (adaptive execution splits a hot
node), and the list of the conversations that end in a node is hashed in order, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.ordered import positions
from sparkloom.llm.store import kept, scope

#: Conversations of one block share turns of the block's first one; up to SPREAD - 1 of them.
BLOCK, SPREAD = 100, 6


def turns(df: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest, chars and before (chars of the turns in front) of every turn.

    Turns are ordered by turn, null first, and where it repeats by digest. Null roles and texts are empty. Repeated rows are
    turns of their own. Rows without conv_id belong to no conversation and are left out. Other columns aren't read.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    flat = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return positions(flat, ["conv_id"], ["turn", "digest"], number="depth", total="chars").select("conv_id", F.col("depth").cast("int").alias("depth"), "digest", "chars", "before")


def rebuilt(own: DataFrame, block: int = BLOCK, spread: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns taken from the first of its block, c - c % block, h = crc32(c) % spread.

    A conversation behind a shorter or absent first one gets fewer turns in front; its own first h go in any case, so that it may
    have none left. own: as ``turns`` gives it. Returns (turns, conversations) for ``build``.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(spread)).cast("int")
    heads = F.array(*(F.sum(F.when(F.col("depth") <= k, F.col("chars")).otherwise(0)) for k in range(spread)))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("chars").alias("total"), heads.alias("heads"))
    convs = kept(convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("first_id"), (F.col("total") - F.get("heads", h)).alias("rest")), "convs")
    first = convs.select(F.col("conv_id").alias("first_id"), F.col("n").alias("n_first"), F.col("heads").alias("heads_first"))
    m = F.least("h", F.coalesce("n_first", F.lit(0)))
    convs = convs.join(first, "first_id", "left").select("conv_id", "first_id", "n", "total", "rest", "h", m.alias("m"), F.coalesce(F.get("heads_first", m), F.lit(0)).alias("head"))
    convs = kept(convs, "convs")
    behind = own.join(convs.select("conv_id", "total", "h", "m"), "conv_id").where("depth > h")
    behind = behind.select("conv_id", (F.col("m") + F.col("depth") - F.col("h")).alias("depth"), "digest", "chars", (F.col("total") - F.col("before")).alias("tail"))
    front = own.where(f"depth < {spread} and conv_id % {block} = 0").withColumnRenamed("conv_id", "first_id").join(convs.select("conv_id", "first_id", "h", "head", "rest"), "first_id").where("depth <= h")
    front = front.select("conv_id", "depth", "digest", "chars", (F.col("head") - F.col("before") + F.col("rest")).alias("tail"))
    size = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return front.unionByName(behind), convs.select("conv_id", size.alias("size"), (F.col("head") + F.col("rest")).alias("tail"))


def plain(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, for ``build``; own: as ``turns`` gives it."""
    convs = kept(own.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("size"), F.sum("chars").alias("tail")), "convs")
    return own.join(convs.select("conv_id", F.col("tail").alias("total")), "conv_id").select("conv_id", "depth", "digest", "chars", (F.col("total") - F.col("before")).alias("tail")), convs


def build(turn_rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie, one row each: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turn_rows: conv_id, depth, digest, chars, tail (chars from this turn to the end); convs: conv_id, size (turns), tail, also of
    those without turns. No conversations give no nodes, not even a root.
    """
    spark = convs.sparkSession
    with scope(spark) as stay:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # ordered by depth, so that a level's turns are a few row groups of the files
        turn_rows = kept(turn_rows.repartitionByRange(n, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
        same = [F.bit_xor(F.xxhash64(*c)).alias(x) for x, c in (("w1", ("depth", "digest")), ("w2", ("digest", "depth")))]
        live = convs.join(turn_rows.groupBy("conv_id").agg(*same), "conv_id", "left").select("conv_id", "size", "tail", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("w1", "w2")))
        live = kept(live, "live")
        one = (F.min("w1") == F.max("w1")) & (F.min("w2") == F.max("w2")) & (F.min("size") == F.max("size"))
        root = live.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), one.alias("settled")).first()
        live = live.select("conv_id", "size", "w1", "w2", F.lit(root.node).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(root.n).cast("long").alias("n"), F.lit(root.settled).cast("boolean").alias("settled"), F.lit(0).cast("long").alias("chars"), "tail")
        levels = [kept(live.withColumn("depth", F.lit(0)), "level")]
        while True:
            depth = len(levels)
            open_ = levels[-1].where(f"not settled and size >= {depth}")
            if open_.isEmpty():
                break
            step = open_.select("conv_id", "size", "w1", "w2", F.col("node").alias("parent")).join(turn_rows.where(F.col("depth") == depth).drop("depth"), "conv_id")
            groups = step.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), one.alias("settled"))
            level = step.join(groups, ["parent", "digest"]).select("conv_id", "size", "w1", "w2", "node", "parent", "n", "settled", "chars", "tail", F.lit(depth).alias("depth"))
            levels.append(kept(level, "level"))
        whole = spark.read.schema(levels[0].schema).parquet(*(x.kept_path for x in levels))
        below = None
        rolled = []
        for level in reversed(levels):
            nodes = level.where("conv_id = node").select("node", "parent", "depth", "n", "settled", "size", "chars", "tail")
            if below is None:
                nodes = nodes.select("*", *(F.lit(None).cast("long").alias(x) for x in ("kids", "leaves", "saved")))
            else:
                kids = below.groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
                nodes = nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left")
            alone, more = F.col("settled"), F.col("n") - 1
            below = kept(
                nodes.select(
                    "node", "parent", "depth", "n", "settled", "size",
                    F.when(alone, (F.col("size") > F.col("depth")).cast("long")).otherwise(F.coalesce("kids", F.lit(0))).alias("n_children"),
                    F.when(alone, 1).otherwise(F.coalesce("leaves", F.lit(1))).cast("long").alias("n_leaves"),
                    F.when(alone, more * F.col("tail")).otherwise(more * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
                ),
                "rolled",
            )
            rolled.append(below)
        heads = spark.read.schema(rolled[0].schema).parquet(*(x.kept_path for x in rolled))
        chains = heads.where("settled and size > depth").select("node", "n", "size", F.col("depth").alias("from"))
        chains = chains.join(turn_rows.select(F.col("conv_id").alias("node"), "depth", "tail"), "node").where("depth > from").select(
            "node", F.col("node").alias("parent"), "depth", "n", (F.col("size") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("tail")).alias("saved_tokens")
        )
        nodes = heads.drop("settled", "size").unionByName(chains)
        ends = whole.where("settled or size = depth").select("node", F.col("size").alias("depth"), "conv_id", "n")
        lone = ends.where("n = 1").select("node", "depth", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
        hashed = kept(lone.unionByName(_hashed(ends.where("n > 1").drop("n"))), "ends")
        out = kept(
            nodes.join(hashed, ["node", "depth"], "left").select(
                F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            ),
            "trie",
        )
        stay.append(out)
    return out


def _hashed(ends: DataFrame) -> DataFrame:
    """ends, the SHA-256 of the ascending conv_ids of each (node, depth).

    Ids are joined to chunks where they lie by ranges; then the chunks of a node pass through its hash in order. A digest is one
    sequence by definition, so a node's chunks meet in one task, but as a stream: it holds a chunk at a time.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, depth, ids = (batch.column(x).to_numpy() for x in ("node", "depth", "conv_id"))
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
            first = np.concatenate([[0], cuts])
            text = [",".join(map(str, x)) for x in np.split(ids, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(depth[first]), pa.array(ids[first]), pa.array(text)], ["node", "depth", "start", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(zip(batch.column("node").to_pylist(), batch.column("depth").to_pylist(), strict=True), batch.column("ids").to_pylist(), strict=True):
                if key == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, sha.hexdigest()))
                at, sha = key, hashlib.sha256(ids.encode())
            if done:
                yield _rows(done)
        if at is not None:
            yield _rows([(*at, sha.hexdigest())])

    def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        node, depth, digest = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int32()), pa.array(digest)], ["node", "depth", "ends"])

    key = ["node", "depth"]
    joined = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(chunks, "node long, depth int, start long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "start").mapInArrow(digests, "node long, depth int, ends string")
