"""Set-based state changes: append-only revisions with a latest-wins view, transition checks, review and case decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.secrets import redact_json
from sparkloom.functions.text import all_text, content_hash
from sparkloom.operators import rules, similarity
from sparkloom.operators.sessions import first_events
from sparkloom.schema import CATEGORIES, MESSAGES, ROLES, RUN_TRANSITIONS


def latest(revisions: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The newest revision of each key; ties by all other columns."""
    rest = [c for c in revisions.columns if c not in (key, at)]
    best = revisions.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r"))
    return best.select(key, "r.*").select(*revisions.columns)


def approved_examples(queue: DataFrame) -> DataFrame:
    """Approved review items as examples of source generated, neither validated nor compared again."""
    return queue.where("status = 'approved'").select("id", "category", F.col("example_data_json").alias("example"), F.lit("generated").alias("source"), F.lit("approved").alias("status"), "group_id")


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue with the decisions (id, status, reviewer, reason) that meet a pending item applied."""
    d = decisions.select("id", F.col("status").alias("_s"), F.col("reviewer").alias("_r"), F.col("reason").alias("_w"))
    hit = (F.col("status") == "pending") & F.col("_s").isNotNull()
    out = queue.join(d, "id", "left")
    for col, new in (("status", "_s"), ("reviewer", "_r"), ("reason", "_w")):
        out = out.withColumn(f"n{col}", F.when(hit, F.col(new)).otherwise(F.col(col)))
    return out.select(*[F.col(f"n{c}").alias(c) if c in ("status", "reviewer", "reason") else F.col(c) for c in queue.columns])


def enqueued(cases: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """Detected cases as pending rows of the queue, with the session's first events as JSON in time order.

    The id is a digest of session, type, signal and the number among equal cases, so a scan that runs again gives the same ids.
    """
    log = first_events(events).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "ts", "event", "data"))).alias("e"))  # at most 500 of a session
    told = log.select("session_id", F.to_json(F.transform("e", lambda x: x.dropFields("n"))).alias("events_json"))
    same = Window.partitionBy("session_id", "case_type", "signal").orderBy("model_version")
    key = F.concat_ws("\x1f", F.col("session_id").cast("string"), "case_type", "signal", F.row_number().over(same))
    empty = [F.lit(None).cast("string").alias(c) for c in ("reviewer", "second_reviewer", "rejection_reason", "edited_example_json")]
    rows = cases.withColumn("case_id", F.concat(F.lit("case_"), F.substring(F.sha2(key, 256), 1, 26))).join(told, "session_id", "left")
    return rows.select("case_id", "session_id", "model_version", "case_type", "priority", "signal", "events_json", F.lit("pending").alias("status"), *empty, at.alias("created_at"), at.alias("updated_at"))


def edited_or_rejected(cases: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """cases with changes (case_id, status editing or rejected, reviewer, reason) applied, whatever their status: editing sets the reviewer, rejecting the reason."""
    c = changes.where("status in ('editing', 'rejected')").select("case_id", F.col("status").alias("_s"), F.col("reviewer").alias("_r"), F.col("reason").alias("_w"))
    out = cases.join(c, "case_id", "left").withColumns({
        "reviewer": F.when(F.col("_s") == "editing", F.col("_r")).otherwise(F.col("reviewer")), "rejection_reason": F.when(F.col("_s") == "rejected", F.col("_w")).otherwise(F.col("rejection_reason")),
        "status": F.coalesce("_s", "status"), "updated_at": F.when(F.col("_s").isNotNull(), at).otherwise(F.col("updated_at")),
    })
    return out.select(*cases.columns)


def edited_and_approved(queue: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """queue with edits (id, example_data_json, reviewer) put in and approved, whatever the status was."""
    e = edits.select("id", F.col("example_data_json").alias("_e"), F.col("reviewer").alias("_r"), F.lit(True).alias("_hit"))
    hit, out = F.coalesce("_hit", F.lit(False)), queue.join(e, "id", "left")
    new = {"example_data_json": F.col("_e"), "status": F.lit("approved"), "reviewer": F.col("_r"), "updated_at": at}
    return out.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


def case_approvals(cases: DataFrame, second: bool = True) -> DataFrame:
    """Cases that may be approved: pending or being edited; a sec case needs a second reviewer other than the first, if there is a first (unless second is False). The example is redacted."""
    able = F.col("status").isin("pending", "editing")
    if second:
        other = F.coalesce(F.trim("second_reviewer"), F.lit(""))
        able = able & ((F.col("case_type") != "sec") | ((other != "") & (other != F.coalesce(F.trim("reviewer"), F.lit("")))))
    return cases.where(able).withColumn("edited_example_json", redact_json("edited_example_json"))


def approved_corrections(cases: DataFrame, peers: DataFrame | None = None, second: bool = True) -> tuple[DataFrame, DataFrame]:
    """Examples of the cases that pass every step of approval, and (case_id, reason) of the others.

    Steps: ``case_approvals``, the schema (a known category, messages of known roles), and the rules, with equal contents in
    peers (content_hash) an error. second: whether sec cases need a second reviewer, as those approved already don't. Tool and loop examples without tools get the registry's; the group is the given one, else the project, else the session.
    """
    able = case_approvals(cases, second)
    shape = f"category string, messages {MESSAGES}, tools string, group_id string"
    parsed = able.withColumn("x", F.from_json("edited_example_json", shape))
    sound = F.col("x.category").isin(*CATEGORIES) & (F.size("x.messages") > 0) & F.forall("x.messages", lambda m: F.coalesce(m["role"].isin(*ROLES) & m["content"].isNotNull(), F.lit(False)))
    parsed = parsed.withColumn("sound", F.coalesce(sound, F.lit(False)))
    group = F.coalesce(F.nullif("x.group_id", F.lit("")), F.nullif("project", F.lit("")), F.concat(F.lit("al/session/"), F.col("session_id").cast("string")))
    rows = parsed.where("sound").select(F.col("case_id").alias("id"), "x.category", "x.messages", "x.tools", F.lit("active_learning").alias("source"), group.alias("group_id"), F.lit("approved").alias("status"))
    rows = rules.with_tools(rows).withColumn("content_hash", content_hash(F.col("messages"), F.col("tools")))
    failed = rules.validate(rows, hash_col=None).where("level = 'err'").select("id", "code")
    if peers is not None:
        failed = failed.unionByName(rows.join(peers.select("content_hash").distinct(), "content_hash", "left_semi").select("id", F.lit("C6").alias("code")))
    failed = failed.groupBy("id").agg(F.concat(F.lit("rules: "), F.array_join(F.array_sort(F.collect_set("code")), ", ")).alias("reason"))
    refused = cases.join(able.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("may not be approved").alias("reason"))
    refused = refused.unionByName(parsed.where("not sound").select("case_id", F.lit("schema").alias("reason"))).unionByName(failed.select(F.col("id").alias("case_id"), "reason"))
    return rows.join(failed, "id", "left_anti"), refused


def accepted_candidates(candidates: DataFrame, existing: DataFrame, evals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (id, category, messages, tools, group_id) that enter the review queue, and (id, reason) of the rejected ones.

    Reasons: exact_duplicate of an existing content_hash or of an earlier candidate, contamination by evals (item_id, text),
    or the codes of rules that are broken. Similar texts are only a warning, so the first of equal candidates is what a
    loop over them would accept.
    """
    rows = candidates.withColumn("content_hash", content_hash(F.col("messages"), F.col("tools")))
    first = rows.groupBy("content_hash").agg(F.min("id").alias("id")).join(existing.select("content_hash").distinct(), "content_hash", "left_anti")
    reasons = rows.join(first, ["content_hash", "id"], "left_anti").select("id", F.lit("exact_duplicate").alias("reason"))
    if evals is not None:
        texts = rows.select(F.col("id").alias("doc_id"), all_text(F.col("messages"), " ").alias("text"))
        reasons = reasons.unionByName(similarity.contamination(texts, evals).select(F.col("doc_id").alias("id"), F.lit("contamination").alias("reason")))
    reasons = reasons.unionByName(rules.validate(rows, hash_col=None).where("level = 'err'").select("id", F.col("code").alias("reason")))
    rejected = reasons.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    return rows.join(rejected, "id", "left_anti").withColumn("status", F.lit("pending")), rejected


def bad_transitions(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """Changes (old, new) that the run states don't allow."""
    allowed = spark.createDataFrame([(a, b) for a, bs in RUN_TRANSITIONS.items() for b in bs], "old string, new string")
    return changes.join(F.broadcast(allowed), ["old", "new"], "left_anti")


def current_production(models: DataFrame) -> DataFrame:
    return models.where("status = 'production'").agg(F.max_by(F.struct(*models.columns), F.struct("promoted_at", "id")).alias("m")).where("m is not null").select("m.*")


def marked_emitted(cases: DataFrame, emitted: DataFrame) -> DataFrame:
    """cases with those emitted into a dataset set to merged."""
    hit = emitted.select("case_id").distinct().withColumn("_e", F.lit(True))
    return cases.join(hit, "case_id", "left").withColumn("status", F.when(F.col("_e"), F.lit("merged")).otherwise(F.col("status"))).drop("_e")
