"""Filtered pages of a table, and the counts and costs that dashboards show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import prompt_key
from sparkloom.schema import MESSAGES, TOKEN_EDGES

# Dollars per million prompt and completion tokens by model, and for any other model.
TOKEN_COSTS = {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "claude-sonnet-4": (3.0, 15.0)}
DEFAULT_COST = (1.0, 3.0)


def matching(rows: DataFrame, equal: dict[str, object] | None = None, q: str | None = None, search: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns equal the given values (None: any) and where a searched column holds q, whatever its case; % and _ in q are wildcards."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if q and search:
        found = [F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{q}%") for c in search]
        rows = rows.where(F.greatest(*found) if len(found) > 1 else found[0])
    return rows


def page(rows: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def list_cases(cases: DataFrame, *, case_type: str | None = None, priority: int | None = None, status: str | None = None, model_version: str | None = None) -> DataFrame:
    """Cases that match, the highest priority first, then the oldest; ties by id."""
    return matching(cases, {"case_type": case_type, "priority": priority, "status": status, "model_version": model_version}).orderBy(F.desc("priority"), "created_at", "case_id")


def approved_cases(cases: DataFrame, limit: int = 1000) -> DataFrame:
    """The approved cases of highest priority."""
    return page(matching(cases, {"status": "approved"}), [F.desc("priority"), F.col("created_at"), F.col("case_id")], limit)


def pending_reviews(queue: DataFrame, category: str | None = None) -> DataFrame:
    """Review items that wait for a decision, the newest first; ties by id."""
    return matching(queue, {"status": "pending", "category": category}).orderBy(F.desc("created_at"), "id")


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == F.lit(value))


def listed(rows: DataFrame, status: str | None = None, *, by: str = "created_at", newest: bool = False) -> DataFrame:
    """Dataset versions, models or runs of a status (None: any) in order of a column; ties by id."""
    return matching(rows, {"status": status}).orderBy(F.desc(by) if newest else F.asc(by), "id")


def decoded(rows: DataFrame) -> DataFrame:
    """Stored examples (messages_json, tools_json) as examples."""
    return rows.select("id", "category", F.from_json("messages_json", MESSAGES).alias("messages"), F.col("tools_json").alias("tools"), "source", "group_id", "status")


def cached_results(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts (prompt) with the result that the cache (key, result, at) holds for them, or null; the newest of a key counts."""
    newest = cache.groupBy("key").agg(F.max_by("result", F.struct("at", "result")).alias("result"))
    return prompts.withColumn("key", prompt_key(F.col("prompt"))).join(newest, "key", "left").drop("key")


def distribution(examples: DataFrame) -> DataFrame:
    """kind, value, n: examples in all, by category, by source, and by what meta, a JSON object, says of language and of the vulnerability.

    A missing category or source counts as unknown; a missing or empty language or vulnerability isn't counted.
    """
    meta = lambda *names: F.coalesce(*(F.nullif(F.get_json_object("meta", f"$.{x}"), F.lit("")) for x in names))
    kinds = {
        "total": F.lit(""), "by_category": F.coalesce("category", F.lit("unknown")), "by_source": F.coalesce("source", F.lit("unknown")),
        "by_language": meta("language", "lang"), "by_vuln_type": meta("vulnerability_type", "injected_flaw"),
    }
    rows = examples.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))))
    return rows.where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def queue_metrics(cases: DataFrame, now: Column) -> DataFrame:
    """total_cases, pending, approved, rejected, and the mean age of pending cases in hours at ``now`` (0 without any)."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    age = F.when(F.col("status") == "pending", (F.unix_micros(now) - F.unix_micros("created_at")) / 3.6e9)
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), n("pending"), n("approved"), n("rejected"), F.round(F.coalesce(F.avg(age), F.lit(0.0)), 2).alias("avg_pending_age_hours"))


def case_types(cases: DataFrame) -> DataFrame:
    """case_type and n, the most frequent first."""
    return cases.groupBy("case_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "case_type")


def estimated_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Dollars of a model call."""

    def rate(side: int) -> Column:
        known = F.create_map(*(F.lit(x) for name, costs in TOKEN_COSTS.items() for x in (name, costs[side])))
        return F.coalesce(known[model], F.lit(DEFAULT_COST[side]))

    return (prompt_tokens * rate(0) + completion_tokens * rate(1)) / 1_000_000


def nearest_checkpoint(checkpoints: DataFrame, step: int) -> DataFrame:
    """The checkpoint (step, path) nearest to a step; the earlier one of two."""
    return checkpoints.agg(F.min_by("path", F.struct(F.abs(F.col("step") - F.lit(step)), "step")).alias("path"))


def outcome_counts(examples: DataFrame, report: DataFrame) -> DataFrame:
    """category, passed and failed examples; report: id, ok."""
    rows = examples.select("id", "category").join(report.select("id", "ok"), "id")
    return rows.groupBy("category").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def code_counts(violations: DataFrame) -> DataFrame:
    """level, code and n of all violations."""
    return violations.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


def length_histogram(rows: DataFrame, size: str, edges: tuple[int, ...] = TOKEN_EDGES) -> DataFrame:
    """bucket and n: rows by the number of edges below their size, with empty buckets; rows of unknown size are bucket -1."""
    bucket = F.when(F.col(size).isNull(), -1).otherwise(sum((F.when(F.col(size) > e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(-1, len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
