"""Dataset versions: approved examples, validated, decontaminated, split and written with a hashed manifest."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import all_text, content_hash
from sparkloom.functions.tokens import rendered, token_count
from sparkloom.operators import rules, similarity, split, workflow
from sparkloom.schema import FEEDBACK_RATIO, VAL_RATIO
from sparkloom.sources.jsonl import export_lines

#: Rows of a part file, at most, as a task hashes a file as a whole.
PART_ROWS = 1_000_000
#: Hex digits that the lines below a node of a tree hash share, from the lowest level up.
LEVELS = (6, 4, 2)


def clean_examples(examples: DataFrame, evals: DataFrame | None, item_text: str = "text", tokens_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Approved examples without errors and without evaluation overlap, and all violations found on the way; too long ones go if tokens_col counts their tokens."""
    rows = examples.where("status = 'approved'").withColumn("content_hash", content_hash(F.col("messages"), F.col("tools")))
    found = rules.validate(rows, tokens_col=tokens_col)
    good = rows.join(found.where("level = 'err'").select("id").distinct(), "id", "left_anti")
    if evals is not None:
        texts = good.select(F.col("id").alias("doc_id"), all_text(F.col("messages")).alias("text"))
        hit = similarity.contamination(texts, evals.withColumnRenamed(item_text, "text")).select(F.col("doc_id").alias("id")).distinct()
        good = good.join(hit, "id", "left_anti")
    return good, found


def build(examples: DataFrame, evals: DataFrame | None = None, *, ratio: float = VAL_RATIO, seed: int = 42, tokens_col: str | None = None) -> DataFrame:
    """The rows of a new version with their split."""
    return split.group_split(clean_examples(examples, evals, tokens_col=tokens_col)[0], ratio=ratio, seed=seed)


def evals_mark(evals: DataFrame | None, item_text: str = "text") -> str:
    """A number that tells the texts of an evaluation side from others, whatever their order."""
    if evals is None:
        return ""
    n, total = evals.agg(F.count(F.lit(1)), F.sum(F.xxhash64(item_text).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def judged(rows: DataFrame, evals: DataFrame | None, item_text: str = "text", tokens_col: str | None = None) -> DataFrame:
    """id, codes and hit: what the content of an id's rows decides by itself, errors but those of copies, and whether it overlaps an evaluation case."""
    errors = rules.validate(rows, hash_col=None, tokens_col=tokens_col).where("level = 'err'").groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = rows.select("id").distinct().join(errors, "id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    if evals is None:
        return out.withColumn("hit", F.lit(False))
    texts = rows.select(F.col("id").alias("doc_id"), all_text(F.col("messages")).alias("text"))
    hit = similarity.contamination(texts, evals.withColumnRenamed(item_text, "text")).select(F.col("doc_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return out.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


MARKS = "id string, mark string, content_hash string, n long"
JUDGED = MARKS + ", codes array<string>, hit boolean"


def build_next(
    examples: DataFrame, evals: DataFrame | None, folder: str, previous: str | None = None, *, categories: list[str] | None = None, ratio: float = VAL_RATIO, seed: int = 42, item_text: str = "text", tokens_col: str | None = None
) -> DataFrame:
    """The rows of ``build`` with their split, where only rows that previous doesn't know as they are now are validated and compared with evals.

    folder and previous: where this build writes what it found out about each row (judged, beside the marks of all
    rows), and where an earlier one did. A row that has changed, or meets other evals, is judged again. Everything after
    that, copies too, is decided on these narrow tables. A build that has no row left is an error, which names the stage.
    categories: those to build from, all if none are given.
    """
    spark = examples.sparkSession
    rows = examples.where("status = 'approved' and id is not null")
    rows = rows.where(F.col("category").isin(categories)) if categories else rows
    _or_error(rows, "no approved examples to build a dataset from")
    content = F.to_json(F.struct("category", "messages", "tools", *([F.col(tokens_col).alias("tokens")] if tokens_col else [])), {"ignoreNullFields": "false"})
    mark = F.sha2(F.concat_ws("\x1f", F.lit(evals_mark(evals, item_text)), content), 256)
    seen = rows.select("id", mark.alias("mark"), content_hash(F.col("messages"), F.col("tools")).alias("content_hash"))
    seen.groupBy("id", "mark", "content_hash").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/marks")
    marks = spark.read.schema(MARKS).parquet(f"{folder}/marks")
    known = spark.read.schema(JUDGED).parquet(f"{previous}/judged") if previous else spark.createDataFrame([], JUDGED)
    fresh = marks.join(known, ["id", "mark"], "left_anti").select("id").distinct()
    kept = marks.join(fresh, "id", "left_anti").join(known.select("id", "mark", "codes", "hit"), ["id", "mark"])
    new = marks.join(judged(rows.join(fresh, "id", "left_semi"), evals, item_text, tokens_col), "id")
    new.unionByName(kept).write.parquet(f"{folder}/judged")
    now = spark.read.schema(JUDGED).parquet(f"{folder}/judged")
    copies = now.groupBy("content_hash").agg(F.sum("n").alias("n")).where("n > 1 and content_hash is not null").select("content_hash")
    bad = now.where("size(codes) > 0").select("id").unionByName(now.join(copies, "content_hash", "left_semi").select("id"))
    sound = _or_error(now.join(bad, "id", "left_anti"), "every approved example failed err-level validation")
    clean = _or_error(sound.join(sound.where("hit").select("id"), "id", "left_anti"), "every approved example overlaps the frozen eval suites")
    out = rows.join(clean.select("id"), "id", "left_semi").withColumn("content_hash", content_hash(F.col("messages"), F.col("tools")))
    return split.group_split(out, ratio=ratio, seed=seed)


def build_feedback(originals: DataFrame, feedback: DataFrame, evals: DataFrame | None = None, *, seed: int = 42, tokens_col: str | None = None) -> DataFrame:
    """Originals with feedback rows of at most FEEDBACK_RATIO of the whole, by id; equal contents and contaminated feedback don't come in."""
    base = clean_examples(originals, None, tokens_col=tokens_col)[0]
    extra = clean_examples(feedback, evals, tokens_col=tokens_col)[0].join(base.select("content_hash"), "content_hash", "left_anti")
    room = int(base.count() * FEEDBACK_RATIO / (1 - FEEDBACK_RATIO))
    return split.regression_split(base, extra.orderBy("id").limit(room).select(*base.columns), seed=seed)


def feedback_version(
    originals: DataFrame, cases: DataFrame, evals: DataFrame | None = None, *, categories: list[str] | None = None, seed: int = 42, tokenizer: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of a version mixed from originals and approved cases, and cases with those that it holds set to merged.

    cases: case_id, session_id, status and edited examples, which are judged as ``workflow.approved_corrections`` does; the first case of
    equal contents counts. At most FEEDBACK_RATIO of the rows are of cases, by case_id; cases beyond that or contaminated stay
    approved. A stage that leaves nothing is an error. tokenizer: the file that counts tokens for C4. The split is that of ``build_feedback``.
    """
    wanted = F.col("category").isin(categories) if categories else F.lit(True)
    columns = ["id", "category", "messages", "tools", "source", "group_id", "status"]
    counted = (lambda d: d.withColumn("tokens", token_count(rendered(F.col("messages"), F.col("tools")), tokenizer))) if tokenizer else (lambda d: d)
    approved, base = _or_error(cases.where("status = 'approved'"), "no approved cases to build a dataset from"), originals.where("status = 'approved'").select(*columns)
    known = base.select(content_hash(F.col("messages"), F.col("tools")).alias("content_hash")).distinct()
    base = _or_error(base.where(wanted), "at least one approved original example is required")
    extra, _ = workflow.approved_corrections(approved.withColumn("status", F.lit("editing")), second=False)
    extra = similarity.first_wins(extra.join(known, "content_hash", "left_anti").where(wanted), "content_hash", "id")
    extra = _or_error(extra, "no new case passes the rules").select(*columns)
    rows = build_feedback(counted(base), counted(extra), evals, seed=seed, tokens_col="tokens" if tokenizer else None)
    _or_error(rows.where("split = 'val'"), "fewer than two groups of original examples pass the rules")
    used = rows.join(extra.select("id"), "id", "left_semi").select(F.col("id").alias("case_id"))
    return rows, workflow.marked_emitted(cases, _or_error(used, "no case is left: all overlap the evaluation cases, or there are too few originals"))


def _or_error(rows: DataFrame, why: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(why)
    return rows


def write_version(rows: DataFrame, path: str, version: str, seed: int, ratio: float = VAL_RATIO) -> dict:
    """Writes one line file for each split, rows by id, and manifest.json with counts and sha256; returns the manifest.

    For folders that the driver can reach and versions that it can write by itself; ``write_parts`` writes larger ones.
    """
    folder = Path(path.removeprefix("file://")) / version
    folder.mkdir(parents=True, exist_ok=True)
    manifest: dict = {"version": version, "seed": seed, "val_ratio": ratio, "counts": {}, "sha256": {}}
    for side in sorted(r[0] for r in rows.select("split").distinct().collect()):
        digest, n = hashlib.sha256(), 0
        with (folder / f"{side}.jsonl").open("wb") as f:
            for row in export_lines(rows.where(F.col("split") == side).orderBy("id")).toLocalIterator():
                line = (row[0] + "\n").encode()
                digest.update(line)
                f.write(line)
                n += 1
        manifest["counts"][side], manifest["sha256"][side] = n, digest.hexdigest()
    (folder / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def write_parts(rows: DataFrame, path: str, version: str, seed: int, ratio: float = VAL_RATIO) -> DataFrame:
    """A version of any size: each split in part files of lines below ``split=``, written by tasks, rows by id within ranges; returns the manifest.

    The manifest (split, file, n, sha256, seed, val_ratio) is hashed by tasks and kept below ``_manifest``; the hash of each
    split as a whole, whatever its files, below ``_tree``.
    """
    folder, spark = f"{path.rstrip('/')}/{version}", rows.sparkSession
    placed = rows.repartitionByRange("split", "id").sortWithinPartitions("split", "id")
    export_lines(placed, "split").write.partitionBy("split").option("maxRecordsPerFile", PART_ROWS).mode("errorifexists").text(folder)
    _stored(tree_hash(_lines(spark, folder), "split"), f"{folder}/_tree")
    return _manifest(spark, folder).withColumns({"seed": F.lit(seed), "val_ratio": F.lit(ratio)}).transform(lambda m: _stored(m, f"{folder}/_manifest"))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """split, file, n and sha256 of the part files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    lines = F.length("content") - F.length(F.translate(F.decode("content", "ISO-8859-1"), "\n", ""))
    return files.select(F.regexp_extract("path", "split=([^/]*)/", 1).alias("split"), F.element_at(F.split("path", "/"), -1).alias("file"), lines.cast("long").alias("n"), F.sha2("content", 256).alias("sha256"))


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def parts_hold(spark: SparkSession, path: str, version: str) -> DataFrame:
    """split, file, holds: whether each file of the manifest is there with its hash, and false for files that it doesn't name."""
    folder = f"{path.rstrip('/')}/{version}"
    stated = spark.read.schema("split string, file string, sha256 string").json(f"{folder}/_manifest").withColumnRenamed("sha256", "stated")
    found = _manifest(spark, folder).select("split", "file", "sha256")
    return stated.join(found, ["split", "file"], "full").select("split", "file", F.coalesce(F.col("stated") == F.col("sha256"), F.lit(False)).alias("holds"))


def tree_hash(lines: DataFrame, split: str, line: str = "value") -> DataFrame:
    """split, n and hash: one hash of all lines of each split that depends neither on their order nor on how they lie in files.

    A tree over the sha256 of the lines: those that share LEVELS[0] hex digits are hashed together in ascending order, then
    the nodes that share fewer digits, each with its digits, up to the root. Repeated lines count, null is a line of its
    own (no digest is empty). A node has at most 256 children, and one of 2^24 parts of all lines' digests.
    """
    leaf = F.coalesce(F.sha2(F.col(line), 256), F.lit(""))
    nodes = lines.select(F.col(split).alias("split"), leaf.alias("h")).groupBy("split", F.substring("h", 1, LEVELS[0]).alias("p"))
    nodes = nodes.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("hash"))
    for width in (*LEVELS[1:], 0):
        parts = F.array_sort(F.collect_list(F.concat("p", F.lit(":"), "hash")))
        nodes = nodes.groupBy("split", F.substring("p", 1, width).alias("q")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(parts, ","), 256).alias("hash")).withColumnRenamed("q", "p")
    return nodes.select("split", "n", "hash")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """value and split of the lines of a version in parts."""
    files = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").text(folder)
    return files.select("value", F.regexp_extract(F.input_file_name(), "split=([^/]*)/", 1).alias("split"))


def splits_hold(spark: SparkSession, path: str, version: str) -> DataFrame:
    """split, holds: whether the lines of each split are those that were written, in any files. Reads line by line."""
    folder = f"{path.rstrip('/')}/{version}"
    stated = spark.read.schema("split string, n long, hash string").json(f"{folder}/_tree").toDF("split", "n_stated", "stated")
    found = tree_hash(_lines(spark, folder), "split")
    return stated.join(found, "split", "full").select("split", F.coalesce((F.col("stated") == F.col("hash")) & (F.col("n_stated") == F.col("n")), F.lit(False)).alias("holds"))


def manifest_holds(path: str, version: str) -> dict[str, bool]:
    """Whether each file of a version still has the hash its manifest states."""
    folder = Path(path.removeprefix("file://")) / version
    manifest = json.loads((folder / "manifest.json").read_text())
    return {side: hashlib.sha256((folder / f"{side}.jsonl").read_bytes()).hexdigest() == h for side, h in manifest["sha256"].items()}
