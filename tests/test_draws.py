"""Seeded mixes and running budgets against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import time

from pyspark.sql import functions as F

from sparkloom.operators import evaluation, split


def test_mix_draws_the_smallest_keys_of_each_stratum(spark):
    rng = random.Random(4)
    rows = [(f"r{k}", rng.choice("aaaaabbc"), rng.choice((1.0, 2.0, 8.0, 0.0, None, -1.0))) for k in range(600)] + [("n", None, 1.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "id string, category string, w double")
    shares = {"a": 0.6, "b": 0.1, "c": 0.3, "none": 0.5}
    draw = lambda d: sorted(r.id for r in split.seeded_mix(d, shares, rate=0.3, weight="w", seed=9).collect())

    def key(r):
        h = hashlib.md5(("9|" + r[0] if r[0] is not None else "9").encode()).hexdigest()
        return -math.log((int(h[:8], 16) + 0.5) / 2**32) / r[2]

    want = []
    for s, share in shares.items():
        able = sorted((r for r in rows if r[1] == s and (r[2] or 0) > 0), key=key)
        want += [r[0] for r in able[: round(round(602 * 0.3) * share)]]
    assert draw(df) == draw(df.repartition(7)) == sorted(want) and len(want) < 181  # c has too few rows
    assert split.seeded_mix(df.limit(0), shares, rate=0.3).count() == 0


def test_mix_follows_the_weights(spark):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("category"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    got = split.seeded_mix(df, {"x": 1.0}, rate=0.05, weight="w").select((F.col("id").cast("long") % 2 == 0).alias("heavy"))
    heavy, n = got.where("heavy").count(), got.count()
    assert n == 2000 and abs(heavy / n - 0.75) < 0.04  # four standard deviations


def test_budget_scan_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([*range(60), None]), rng.choice([0.5, 3.0, 7.0, 20.0, 0.0, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, c double")
    got = {}
    for r in evaluation.budget_scan(df, "k", "i", "c", 25.0).collect():
        got.setdefault(r.k, []).append((r.i, r.c, r.accepted, r.spent))
    last = lambda x: (x is None, x or 0)
    for k in ("a", "b", None):
        spent, want = 0.0, []
        for _, i, c in sorted((r for r in rows if r[0] == k), key=lambda r: (last(r[1]), last(r[2]))):
            fits = c is not None and spent + c <= 25.0
            spent += c if fits else 0
            want.append((i, c, fits, spent))
        assert got[k] == want
    assert evaluation.budget_scan(df.limit(0), "k", "i", "c", 1.0).count() == 0


def test_budget_of_one_key_with_a_million_items(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit(0.25).alias("c"))
    began = time.time()
    r = evaluation.budget_scan(df, "k", "i", "c", 100_000.0).agg(F.count_if("accepted").alias("n"), F.max("spent").alias("s"), F.max(F.when(F.col("accepted"), F.col("i"))).alias("i")).first()
    assert (r.n, r.s, r.i) == (400_000, 100_000.0, 399_999) and time.time() - began < 60
