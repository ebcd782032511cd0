"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Everything stays in DataFrames: minima are partial aggregates, the joins back have a plain exchange on either side, so
adaptive execution can split a node with very many links, and every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import kept, scope

MAX_ROUNDS = 50


def _minima(sym: DataFrame) -> DataFrame:
    return kept(sym.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _star(links: DataFrame, large: bool) -> DataFrame:
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:  # every larger neighbour is linked with the smallest one
        sym = links.unionByName(back)
        best = _minima(sym).select("u", F.least("u", "m").alias("m"))
        out = sym.where("v > u").join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # links point from the larger to the smaller end
        best = _minima(links)
        joined = links.join(best, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.unionByName(best.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end: then the smaller ends are the roots."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of any one orderable type -> (node, root): root is the smallest node that links reach.

    Nodes without a link to another node aren't returned. Null ends, loops and repeated links count for nothing.
    """
    links = links.where("u is not null and v is not null and u != v")
    links = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _is_settled(links):
            break
        with scope(links.sparkSession) as out:
            links = kept(_star(kept(_star(links, True), "links"), False), "links")
            out.append(links)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that links reach, for nodes 0..n-1 of links held in memory."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root
