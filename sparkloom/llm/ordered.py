"""Row numbers and running sums inside keys of any size: a key that holds most rows is spread over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import kept


def positions(df: DataFrame, keys: list[str], order: list[str], *, number: str = "k", total: str | None = None, before: str = "before") -> DataFrame:
    """df with ``number``, the place (from 1) of each row among those of its keys by ``order``, nulls first.

    With ``total`` also ``before``, the sum of that column over the rows in front. Null keys are one key. Rows are dealt by
    ranges of keys and order, numbered inside each range, and what the ranges before hold of the same key is added: a range
    has at most one key that began in an earlier one, so the table of those offsets has a row for each partition at most.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(total).alias("_total")] if total else [])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(*sums)
    parts = parts.select("*", F.sum("_n").over(earlier).alias("_n0"), *([F.sum("_total").over(earlier).alias("_t0")] if total else [])).where("_n0 is not null")
    parts = parts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), "_n0", *["_t0"] * bool(total))
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    out = placed.withColumn("_k", F.row_number().over(here))
    if total:
        out = out.withColumn("_b", F.sum(total).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    out = out.join(F.broadcast(parts), same, "left").withColumn(number, F.col("_k") + F.coalesce("_n0", F.lit(0)))
    if total:
        out = out.withColumn(before, F.coalesce("_b", F.lit(0)) + F.coalesce("_t0", F.lit(0)))
    return out.select(*df.columns, number, *[before] * bool(total))
