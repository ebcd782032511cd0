"""Line-delimited JSON: import with quarantine, export, tolerant and strict readers, and the files of evaluation suites."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import content_hash, json_string
from sparkloom.schema import MESSAGES, STATUSES

_LINE = f"id string, category string, messages {MESSAGES}, tools string, meta struct<source:string,group:string,status:string>, _corrupt string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, in its file) and value of all lines. Splits of a file are numbered by themselves and then by the splits before."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    blocks = raw.groupBy("file", "block").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("low") + 1).alias("shift"))
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("k") + F.col("shift")).alias("line"), "value")


def import_lines(spark: SparkSession, path: str, existing: DataFrame | None = None, default_status: str = "draft") -> tuple[DataFrame, DataFrame]:
    """Good examples and bad lines (file, line from 1, error) of line files.

    Blank lines are skipped. A line must be a JSON object with messages; id must be a string or absent, meta.status a known
    status or absent. Contents that are known already, or stand earlier in the file, are reported as duplicates. An id that
    existing has, or an earlier line, is replaced by one made from the line, as is an absent one.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull() | ~F.trim("value").startswith("{"), "not a JSON object").when(F.col("r.messages").isNull(), "no messages")
    error = error.when(F.col("r.meta.status").isNotNull() & ~F.col("r.meta.status").isin(*STATUSES), "unknown status")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.id", "variant"))
    error = error.when(~F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID"), "id is not a string")
    rows = parsed.withColumn("error", error)
    good = rows.where("error is null").select(
        "file", "line", F.col("r.id").alias("given"), F.concat(F.lit("ex_"), F.sha2("value", 256).substr(1, 26)).alias("made"), "r.category", "r.messages", "r.tools", F.coalesce("r.meta.source", F.lit("manual")).alias("source"),
        F.col("r.meta.group").alias("group_id"), F.coalesce("r.meta.status", F.lit(default_status)).alias("status"),
    ).withColumn("content_hash", content_hash(F.col("messages"), F.col("tools")))
    place = F.struct("file", "line")
    first = good.groupBy("content_hash").agg(F.min(place).alias("p")).select("content_hash", "p.file", "p.line")
    if existing is not None:
        first = first.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")
    kept = good.join(first, ["content_hash", "file", "line"], "left_semi")
    free = kept.where("given is not null").groupBy("given").agg(F.min(place).alias("p")).select(F.col("given").alias("id"), "p.file", "p.line")
    if existing is not None and "id" in existing.columns:
        free = free.join(existing.select("id").distinct(), "id", "left_anti")
    kept = kept.join(free, ["file", "line"], "left").select(F.coalesce("id", "made").alias("id"), "category", "messages", "tools", "source", "group_id", "status", "content_hash")
    again = good.join(first, ["content_hash", "file", "line"], "left_anti").select("file", "line", F.lit("duplicate").alias("error"))
    bad = rows.where("error is not null").select("file", "line", F.substring("error", 1, 300).alias("error"))
    return kept, bad.unionByName(again)


def export_lines(examples: DataFrame, *others: str) -> DataFrame:
    """One JSON object a row (value): id, category, messages, tools, meta; other columns follow."""
    body = F.concat(
        F.lit('{"id": '), json_string(F.col("id")), F.lit(', "category": '), json_string(F.col("category")), F.lit(', "messages": ['),
        F.array_join(F.transform("messages", lambda m: F.concat(F.lit('{"role": '), json_string(m["role"]), F.lit(', "content": '), json_string(m["content"]), F.lit("}"))), ", "),
        F.lit('], "tools": '), F.coalesce("tools", F.lit("null")), F.lit(', "meta": '),
        F.to_json(F.struct("source", F.col("group_id").alias("group"), "status"), {"ignoreNullFields": "false"}), F.lit("}"),
    )
    return examples.select(body.alias("value"), *others)


def write_lines(examples: DataFrame, path: str) -> None:
    export_lines(examples).write.mode("errorifexists").text(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def named_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good lines (file, line, the fields of schema) and bad ones (file, line, error); blank lines are skipped."""
    lines = numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = F.when(~F.col("value").rlike(r"^\s*\{"), "not a JSON object").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "invalid JSON")
    rows = parsed.withColumn("error", error)
    return rows.where("error is null").select("file", "line", "r.*").drop("_corrupt"), rows.where("error is not null").select("file", "line", "error")


def read_named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_strict``, but the ValueError of a malformed line names the first one; runs a job to look for it."""
    good, bad = named_lines(spark, path, schema)
    first = bad.orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first.error} in {first.file}:{first.line}")
    return good.drop("file", "line")


def _item_text(item: dict[str, Any]) -> str:
    """The contents of its messages, else its prompt, else the item itself as JSON."""
    messages = item.get("messages")
    if isinstance(messages, list) and messages:
        return " ".join(str(m.get("content") or "") for m in messages if isinstance(m, dict))
    return str(item["prompt"]) if item.get("prompt") else json.dumps(item, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("text", T.StringType())])))
def _items(values: pd.Series, whole: pd.Series) -> pd.Series:
    def found(value: str, is_file: bool) -> list[dict[str, str]]:
        try:
            got = json.loads(value)
        except ValueError:
            return []
        if is_file and isinstance(got, dict):
            got = got.get("examples")
        items = got if is_file and isinstance(got, list) else [] if is_file else [got]
        return [{"item": json.dumps(x, ensure_ascii=False, sort_keys=True), "text": _item_text(x)} for x in items if isinstance(x, dict)]

    return pd.Series([found(v, w) for v, w in zip(values, whole, strict=True)], dtype=object)


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """item (canonical JSON) and text of all cases below path: objects in lines of .jsonl files, and in .json files that hold a list or {"examples": [...]}.

    Lines, files and entries that are something else are left out.
    """
    found = lambda name, whole: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", whole).text(path).select("value", F.lit(whole).alias("whole"))
    return found("*.jsonl", False).unionByName(found("*.json", True)).select(F.inline(_items("value", "whole")))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of line files; ``read_tolerant`` reads it."""
    rows.write.mode("append").json(path)


def calibration_text(examples: DataFrame, n: int, seed: int, corpus: DataFrame | None = None, n_corpus: int = 50) -> DataFrame:
    """Messages of the first n examples and n_corpus texts (value) of a corpus as lines, mixed in a seeded order; empty ones are left out."""
    order = lambda *key: F.sha2(F.concat_ws("|", F.lit(str(seed)), *key), 256).alias("o")
    lines = examples.orderBy("id").limit(n).select("id", F.posexplode("messages").alias("k", "m")).select(order("id", "k"), F.col("m.content").alias("value"))
    if corpus is not None:
        lines = lines.unionByName(corpus.select(order(F.lit("corpus"), F.col("value")), "value").orderBy("o", "value").limit(n_corpus))
    return lines.where("value <> ''").orderBy("o", "value").select(F.replace("value", F.lit("\n"), F.lit(" ")).alias("value"))
