"""Reproducible splits: groups stay whole, strata keep their share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.schema import VAL_RATIO


def group_split(rows: DataFrame, *, id_col: str = "id", stratum: str = "category", group: str = "group_id", ratio: float = VAL_RATIO, seed: int = 42, spare_last: bool = False) -> DataFrame:
    """Adds split (train or val).

    In each stratum the groups (a row without one is its own) are put in the order of a seeded hash and go to val whole
    while val has fewer rows than max(1, round-half-even(n * ratio)); a stratum of one row or one group is all train.
    spare_last: a stratum's last group in that order never goes to val. The order is summed up within buckets of the hash
    and then over buckets, so no task sorts all groups of a stratum.
    """
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("__solo__"), F.col(id_col).cast("string")))
    keyed = rows.withColumn("_g", key)
    sizes = keyed.groupBy(stratum, "_g").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_o", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(stratum), F.col("_g")), 256))
    sizes = sizes.withColumn("_b", F.substring("_o", 1, 3)).withColumn("_s", F.col(stratum))
    buckets = sizes.groupBy("_s", "_b").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    by = Window.partitionBy("_s")
    earlier = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("_s").alias("_t"), F.col("_b").alias("_c"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_low"), F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_at"),
        F.sum("_rows").over(by).alias("_size"), F.sum("_groups").over(by).alias("_count"),
    )
    sizes = sizes.join(buckets, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")))
    within = Window.partitionBy("_s", "_b").orderBy("_o", "_g")
    before = F.col("_low") + F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(ratio)))
    val = (F.col("_count") > 1) & (F.col("_size") > 1) & (before < target)
    if spare_last:
        val = val & (F.col("_at") + F.row_number().over(within) < F.col("_count"))
    sides = sizes.select(stratum, "_g", F.when(val, F.lit("val")).otherwise(F.lit("train")).alias("split"))
    return keyed.join(sides, (keyed["_g"] == sides["_g"]) & keyed[stratum].eqNullSafe(sides[stratum])).drop(sides["_g"]).drop(sides[stratum]).drop("_g")


def regression_split(rows: DataFrame, feedback: DataFrame, *, ratio: float = VAL_RATIO, holdout: float = 0.2, seed: int = 42, id_col: str = "id", group: str = "group_id") -> DataFrame:
    """Originals into train and val (whole groups, not stratified); feedback rows into train (one group at least) and regression, never val."""
    one = rows.withColumn("_all", F.lit("originals"))
    more = feedback.withColumn("_all", F.lit("feedback"))
    a = group_split(one, id_col=id_col, stratum="_all", group=group, ratio=ratio, seed=seed)
    b = group_split(more, id_col=id_col, stratum="_all", group=group, ratio=holdout, seed=seed + 1, spare_last=True)
    return a.unionByName(b.withColumn("split", F.when(F.col("split") == "val", F.lit("regression")).otherwise(F.col("split")))).drop("_all")


def leaking_groups(split: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups that stand on more than one side."""
    return split.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(group)


def split_counts(split: DataFrame, stratum: str = "category") -> DataFrame:
    return split.groupBy(stratum, "split").agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)), 256), id_col).limit(n)


def seeded_mix(rows: DataFrame, shares: dict[str, float], *, rate: float, stratum: str = "category", weight: str | None = None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A mix of bround(rate * rows) rows of which each stratum gives its share (bround), drawn by weight without replacement.

    A row's key is -ln(u) / weight with u from a hash of seed and id, and the smallest keys of a stratum are drawn: the same
    rows however they are partitioned. Rows whose weight is null or not positive and strata without a share are never
    drawn; a stratum that has too few rows gives all of them. Ties go by id. Keys are counted by buckets of their
    logarithm, so that only the bucket at the end of the draw (under 2 % of it) is put in order.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    quota = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))))
    keyed = rows.withColumn("_k", F.when(w > 0, -F.ln(u) / w)).withColumn("_b", F.floor(F.ln("_k") * 64)).withColumn("_s", F.when(F.col(stratum).isin(*shares), F.col(stratum)))  # others count together
    counts = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))  # over a few thousand buckets a stratum
    by = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_want", F.bround(F.bround(total * F.lit(rate)) * quota[F.col("_s")])).where("_b is not null")
    counts = counts.withColumn("_low", F.coalesce(F.sum("_n").over(by), F.lit(0))).where("_low < _want").withColumnsRenamed({"_s": "_t", "_b": "_c"})
    found = keyed.join(F.broadcast(counts), (F.col("_s") == F.col("_t")) & (F.col("_b") == F.col("_c")))
    whole = F.col("_low") + F.col("_n") <= F.col("_want")
    edge = found.where(~whole).withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_k", id_col))).where("_low + _r <= _want")
    return found.where(whole).select(rows.columns).unionByName(edge.select(rows.columns))


def next_version(ids: DataFrame, col: str = "id", prefix: str = "v", width: int = 4) -> DataFrame:
    """The id after the largest numeric suffix."""
    top = F.max(F.try_to_number(F.regexp_extract(col, rf"^{prefix}(\d+)$", 1), F.lit("999999999")).cast("long"))
    return ids.agg(F.concat(F.lit(prefix), F.lpad((F.coalesce(top, F.lit(0)) + 1).cast("string"), width, "0")).alias("next_id"))
