"""The hash of a split: the same for any files, another one for any change."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.operators import dataset
from sparkloom.schema import EXAMPLES


def test_hash_depends_on_lines_alone(spark):
    rows = [("train", f"line {k % 70}") for k in range(100)] + [("val", "x"), ("val", None), ("val", "")]
    df = spark.createDataFrame(rows, "split string, value string")
    hashes = lambda d: {(r.split, r.n, r.hash) for r in dataset.tree_hash(d, "split").collect()}
    one = hashes(df.coalesce(1))
    assert one == hashes(df.repartition(50)) and {(s, n) for s, n, _ in one} == {("train", 100), ("val", 3)}
    more = spark.createDataFrame([("train", "line 1")], df.schema)
    assert len(one & hashes(df.unionByName(more))) == 1 and not hashes(df.limit(0))
    assert len(one & hashes(df.withColumn("value", F.coalesce("value", F.lit(""))))) == 1  # null isn't empty
    long = spark.createDataFrame([("s", "y" * 3_000_000)], df.schema)
    assert hashes(long) != hashes(long.withColumn("value", F.concat("value", F.lit("y"))))


def test_versions_hold_their_lines(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{k}", "plan", [("user", f"text {k}\r\nmore")], None, "s", None, "approved") for k in range(40)], EXAMPLES).withColumn("split", F.when(F.col("id") < "e3", "train").otherwise("val"))
    dataset.write_parts(rows.repartition(5), str(tmp_path), "v1", 42)
    hold = lambda: {r.split: r.holds for r in dataset.splits_hold(spark, str(tmp_path), "v1").collect()}
    assert hold() == {"train": True, "val": True}
    files = sorted(Path(tmp_path, "v1").glob("split=val/part-*"))
    lines = b"".join(f.read_bytes() for f in files).splitlines(keepends=True)
    for f in files[1:]:
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    for f in Path(tmp_path, "v1").glob("split=val/.part-*.crc"):
        f.unlink()
    files[0].write_bytes(b"".join(reversed(lines)))
    assert hold() == {"train": True, "val": True}  # other files, the same lines
    files[0].write_bytes(b"".join(lines[1:]) + json.dumps({"id": "new"}).encode() + b"\n")
    assert hold() == {"train": True, "val": False}
