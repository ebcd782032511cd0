"""The rule catalogue: violations of single examples and of whole datasets.

Structural rules are array expressions. The rules that need strict JSON (calls, plans, reviews) run in one Arrow-batched
function that parses every conversation once and applies all rules of its category.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.chat_json import argument_problems, strict_object, tool_calls
from sparkloom.functions.secrets import found_secrets
from sparkloom.functions.text import all_text
from sparkloom.operators.similarity import near_duplicates, with_first
from sparkloom.schema import GIVE_UP_SHARE, MAX_SEQ_LEN, MIN_PER_TYPE, PASS_WINDOW, PLAN_STATUSES, REQUIRED_TYPES, ROLES, TOOLS, VIOLATION_TYPE, VIOLATIONS

# Phrases that mark failed tool results, giving up, and partial files; English and Thai.
FAILURE = ("error", "not found", "no such file", "traceback", "failed", "failure", "permission denied", "denied", "cannot", "can't", "unable", "invalid", "ไม่พบ", "ผิดพลาด", "ล้มเหลว", "ไม่สามารถ")
GIVE_UP = (
    "cannot complete", "can't complete", "could not complete", "unable to complete", "cannot proceed", "can't proceed", "unable to proceed", "cannot continue", "can't continue",
    "stopping here", "stopped", "giving up", "report the failure", "reporting the failure", "ไม่สามารถดำเนินการ", "ไม่สามารถทำต่อ", "ไม่สามารถดำเนินการต่อ", "ทำไม่ได้", "ต้องหยุด", "ขอรายงาน", "รายงานว่าล้มเหลว",
)
PARTIAL = ("rest of the file", "remains unchanged", "remains the same", "unchanged", "same as before", "existing content", "ส่วนที่เหลือ", "เหมือนเดิม", "ไม่เปลี่ยนแปลง", "...")
DIFF_MARKS = (r"(?m)^\s*@@ .* @@", r"(?m)^\s*\+[^+~]", r"(?m)^\s*-[^-~]", r"<<<<<<< |>>>>>>> |=======\n")
PLAN_FIELDS, ISSUE_FIELDS = ("status", "target_version", "critique", "final_plan"), ("file", "line", "type", "severity", "fix")
SEVERITIES = ("critical", "high", "medium", "low")
VERSION = r"^v\d+(\.\d+){1,2}$"


def failed_result(text: str) -> bool:
    low = text.strip().lower()
    return low.startswith(("error", "failed")) or (low.startswith("{") and '"error"' in low) or any(m in low for m in FAILURE)


def gives_up(messages: list[dict[str, str]]) -> bool:
    """Whether the last assistant turn makes no call and says that the task ends unfinished."""
    last = next((m["content"] or "" for m in reversed(messages) if m["role"] == "assistant"), None)
    return last is not None and not tool_calls(last)[0] and any(m in last.lower() for m in GIVE_UP)


def hunk_lines(diff: str) -> set[int] | None:
    """New-file line numbers that a unified diff shows; None without a hunk header."""
    seen, line, found = False, 0, set()
    for row in diff.splitlines():
        header = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", row)
        if header:
            seen, line = True, int(header[1])
        elif seen and not row.startswith(("+++", "---")) and row[:1] in ("+", " ", ""):  # an empty line is context
            found.add(line)
            line += 1
    return found if seen else None


def call_results(messages: list[dict[str, str]]) -> list[tuple[dict[str, Any], str, int]]:
    """Each call with the tool message that answers it: the k-th call of a turn with the k-th tool message right after."""
    out = []
    for k, m in enumerate(messages):
        if m["role"] == "assistant":
            for j, call in enumerate(tool_calls(m["content"])[0]):
                at = k + 1 + j
                if at < len(messages) and all(x["role"] == "tool" for x in messages[k + 1 : at + 1]):
                    out.append((call, messages[at]["content"] or "", k))
    return out


def _tool_rules(messages: list[dict[str, str]], add: Any, category: str) -> None:
    total = 0
    for k, m in enumerate(messages):
        if m["role"] != "assistant":
            continue
        calls, issues, _ = tool_calls(m["content"])
        total += len(calls)
        for issue in issues:
            add("T1", "err", issue, f"message {k}")
        for call in calls:
            if call["name"] not in TOOLS:
                add("T2", "err", f"unknown tool {call['name']}", f"message {k}")
            else:
                for problem in argument_problems(call["name"], call["arguments"]):
                    add("T3", "err", problem, f"message {k}")
            content = call["arguments"].get("content")
            if call["name"] == "write_file" and isinstance(content, str):
                if any(re.search(p, content) for p in DIFF_MARKS) or any(p in content.lower() for p in PARTIAL):
                    add("T6", "err", "write_file content is not a whole file", f"message {k}")
        follow = next((j for j, x in enumerate(messages[k + 1 :]) if x["role"] != "tool"), len(messages) - k - 1)
        if follow < len(calls):
            add("T4", "err", f"{len(calls)} calls, {follow} results", f"message {k}")
    if not total:
        add("T1", "err", "no tool call", None)
    elif category == "tool" and not 3 <= total <= 6:
        add("T5", "warn", f"{total} calls", None)


def _loop_rules(messages: list[dict[str, str]], add: Any) -> None:
    pairs = call_results(messages)
    failed = [failed_result(result) for _, result, _ in pairs]
    if pairs and not any(failed):
        add("L1", "warn", "no failed result", None)
    for k, (call, _, at) in enumerate(pairs):
        if failed[k] and k + 1 < len(pairs) and (pairs[k + 1][0]["name"], pairs[k + 1][0]["arguments"]) == (call["name"], call["arguments"]):
            add("L2", "err", "the next call repeats the failed one", f"message {at}")
        if failed[k] and any(later["block"] == call["block"] for later, _, _ in pairs[k + 1 :]):
            add("L3", "err", "a later call repeats the failed one", f"message {at}")


def _plan_rules(messages: list[dict[str, str]], add: Any) -> None:
    value, why = strict_object(next((m["content"] for m in reversed(messages) if m["role"] == "assistant"), None))
    if value is None:
        add("P1", "err", why, None)
        return
    for field in PLAN_FIELDS:
        if field not in value:
            add("P2", "err", f"missing {field}", None)
    if "status" in value and value["status"] not in PLAN_STATUSES:
        add("P3", "err", "unknown status", None)
    if "target_version" in value and not re.match(VERSION, str(value["target_version"])):
        add("P4", "warn", "version is not vN.N", None)


def _review_rules(messages: list[dict[str, str]], add: Any) -> None:
    value, why = strict_object(next((m["content"] for m in reversed(messages) if m["role"] == "assistant"), None))
    if value is None:
        add("S1", "err", why, None)
        return
    status, issues = value.get("status"), value.get("issues")
    if status is not None and status not in ("PASS", "REJECT"):
        add("S2", "err", "unknown status", None)
    if status == "PASS" and issues:
        add("S5", "warn", "PASS with issues", None)
    if status != "REJECT":
        return
    if not isinstance(issues, list) or not issues:
        add("S3", "err", "REJECT without issues", None)
    if not isinstance(issues, list):
        return
    for k, issue in enumerate(issues):
        for problem in _issue_problems(issue):
            add("S3", "err", problem, f"issue {k}")
    lines = hunk_lines("\n".join(m["content"] or "" for m in messages if m["role"] in ("user", "tool")))
    if lines is None:
        add("S4", "err", "no diff hunk", None)
    if lines is None:
        return
    for k, issue in enumerate(issues):
        line = issue.get("line") if isinstance(issue, dict) else None
        if _is_whole(line) and line not in lines:
            add("S4", "err", f"line {line} is not in the diff", f"issue {k}")


def _is_whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _issue_problems(issue: Any) -> list[str]:
    """Why an issue isn't well formed."""
    if not isinstance(issue, dict):
        return ["issue is not an object"]
    missing = [f for f in ISSUE_FIELDS if f not in issue]
    if missing:
        return [f"issue lacks {', '.join(missing)}"]
    out = [f"{f} is empty" for f in ("file", "type", "fix") if not str(issue[f]).strip()]
    if not _is_whole(issue["line"]):
        out.append("line is not an integer")
    return out + ["unknown severity"] * (str(issue["severity"]).lower() not in SEVERITIES)


#: Categories whose rules read JSON.
JSON_CATEGORIES = ("tool", "loop", "plan", "sec")


def category_violations(category: str | None, messages: list[dict[str, str]]) -> list[dict[str, str | None]]:
    """Violations of the rules that read JSON."""
    out: list[dict[str, str | None]] = []

    def add(code: str, level: str, message: str | None, location: str | None) -> None:
        out.append({"code": code, "level": level, "message": message, "location": location})

    if category in ("tool", "loop"):
        _tool_rules(messages, add, category)
    if category == "loop":
        _loop_rules(messages, add)
    if category == "plan":
        _plan_rules(messages, add)
    if category == "sec":
        _review_rules(messages, add)
    return out


@F.pandas_udf(VIOLATION_TYPE)
def _category_violations(category: pd.Series, messages: pd.Series) -> pd.Series:
    return pd.Series([category_violations(c, [dict(m) for m in (x if x is not None else [])]) for c, x in zip(category, messages, strict=True)])


def _violation(code: str, level: str, message: str, location: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(message).alias("message"), (F.lit(None) if location is None else location).cast("string").alias("location"))


def structure(messages: Column, tools: Column, tokens: Column | None = None) -> Column:
    """Violations of C1 to C5 as one array; C4 only if tokens are given."""
    role = lambda i: F.try_element_at(messages, i + 1)["role"]
    places = F.when(F.size(messages) > 0, F.sequence(F.lit(0), F.size(messages) - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast(VIOLATIONS)

    def where(cond: object, code: str, message: str) -> Column:
        return F.transform(F.filter(places, cond), lambda i: _violation(code, "err", message, F.concat(F.lit("message "), i)))

    before = lambda i: F.when(i > 0, role(i - 1))
    out = [
        F.when(F.size(messages) == 0, F.array(_violation("C1", "err", "no messages"))).otherwise(none),
        where(lambda i: ~F.coalesce(role(i).isin(*ROLES), F.lit(False)), "C1", "unknown role"),
        where(lambda i: (i > 0) & (role(i) == "system") & (role(F.lit(0)) == "system"), "C1", "system turn later on"),
        where(lambda i: (i > 0) & role(i).isin("user", "assistant") & (role(i) == before(i)), "C1", "same role twice"),
        where(lambda i: (role(i) == "tool") & ~F.coalesce(before(i).isin("assistant", "tool"), F.lit(False)), "C1", "tool turn without a call"),
        F.when(role(F.size(messages) - 1) != "assistant", F.array(_violation("C1", "err", "last turn is not the assistant's"))).otherwise(none),
        where(lambda i: ~F.coalesce(F.try_element_at(messages, i + 1)["content"].rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)), "C2", "empty content"),
        F.when(~F.exists(messages, lambda m: m["role"] == "assistant"), F.array(_violation("C3", "err", "no assistant turn"))).otherwise(none),
        where(lambda i: F.size(found_secrets(F.try_element_at(messages, i + 1)["content"])) > 0, "C5", "secret in content"),
        F.when(F.size(found_secrets(F.coalesce(tools, F.lit("")))) > 0, F.array(_violation("C5", "err", "secret in tools"))).otherwise(none),
    ]
    if tokens is not None:
        out.append(F.when(tokens > MAX_SEQ_LEN, F.array(_violation("C4", "err", "too many tokens"))).otherwise(none))
    return F.concat(*(F.coalesce(x, none) for x in out))


def _alike(texts: DataFrame) -> DataFrame:
    """id, peer: each row of texts (id, hash, text) with the first row of every similar text, and of its own text under another hash."""
    rows = with_first(texts, id_col="id")
    near = near_duplicates(texts, id_col="id").select(F.inline(F.expr("array(struct(first_id, second_id as peer), struct(second_id as first_id, first_id as peer))")))
    # rows of one normalised text: the first row of the first hash, and for that hash's rows the first row of the others
    low = rows.groupBy("first_id", "hash").agg(F.min("id").alias("low"))
    top = low.groupBy("first_id").agg(F.min(F.struct("low", "hash")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "top")
    others = low.join(top, "first_id").where("not hash <=> top.hash").groupBy("first_id", "top").agg(F.min("low").alias("second"))
    same = rows.join(others, "first_id").select("id", F.expr("if(hash <=> top.hash, second, top.low)").alias("peer"))
    return rows.join(near, "first_id").select("id", "peer").unionByName(same)


def validate(examples: DataFrame, hash_col: str | None = "content_hash", tokens_col: str | None = None) -> DataFrame:
    """Violations of every example in long form: id, code, level, message, location. C6 is found by joins, the others row by row.

    C6 warns every example once for each similar text other than its own, naming that text's first example, and once for examples that differ only in case or
    white space. C4 needs ``tokens_col``, the tokens of each rendered example (``functions.tokens``); without it, or where it's null, C4 is skipped.
    """
    of_kind = F.when(F.col("category").isin(*JSON_CATEGORIES), F.col("messages"))  # no rule reads those of others
    # inline of the array itself: of a column that holds it, Spark infers a filter on its size, which computes all of it twice
    found = examples.select("id", F.inline(F.concat(structure(F.col("messages"), F.col("tools"), F.col(tokens_col) if tokens_col else None), _category_violations("category", of_kind))))
    if not hash_col:
        return found
    copies = examples.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = examples.join(copies, hash_col).select("id", F.lit("C6").alias("code"), F.lit("err").alias("level"), F.lit("exact duplicate").alias("message"), F.lit(None).cast("string").alias("location"))
    warn = _alike(examples.select("id", F.col(hash_col).alias("hash"), all_text(F.col("messages")).alias("text")))
    warn = warn.select("id", F.lit("C6").alias("code"), F.lit("warn").alias("level"), F.lit("near duplicate").alias("message"), F.col("peer").cast("string").alias("location"))
    return found.unionByName(exact).unionByName(warn)


def report(examples: DataFrame, violations: DataFrame) -> DataFrame:
    """id, ok (no err), errors, warnings of every example."""
    counts = violations.groupBy("id").agg(F.count_if(F.col("level") == "err").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return examples.select("id").join(counts, "id", "left").select("id", (F.coalesce("errors", F.lit(0)) == 0).alias("ok"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def report_json(examples: DataFrame, violations: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """id and the report of every example as JSON: ok, violations in order of code, skipped rules."""
    found = violations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "level", "message", "location"))).alias("violations"))
    listed = F.coalesce("violations", F.array().cast(VIOLATIONS))
    body = F.struct((~F.exists(listed, lambda v: v["level"] == "err")).alias("ok"), listed.alias("violations"), F.array(*map(F.lit, skipped)).cast("array<string>").alias("skipped"))
    return examples.select("id").join(found, "id", "left").select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


@F.pandas_udf(T.BooleanType())
def _gives_up(messages: pd.Series) -> pd.Series:
    return pd.Series([gives_up([dict(m) for m in x]) for x in messages])


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))]))
def _review(messages: pd.Series) -> pd.DataFrame:
    status, types = [], []
    for x in messages:
        value = strict_object(next((m["content"] for m in reversed(list(x)) if m["role"] == "assistant"), None))[0] or {}
        status.append(value.get("status") if isinstance(value.get("status"), str) else None)
        issues = value.get("issues") if isinstance(value.get("issues"), list) else []
        types.append([str(i["type"]).lower() for i in issues if isinstance(i, dict) and i.get("type")])
    return pd.DataFrame({"status": status, "types": types})


@F.pandas_udf(T.StringType())
def _review_status(messages: pd.Series) -> pd.Series:
    last = lambda x: next((m["content"] for m in reversed(list(x)) if m["role"] == "assistant"), None)
    found = (strict_object(last(x))[0] for x in messages)
    return pd.Series(["unparsed" if v is None else str(v.get("status")) for v in found], dtype=object)


def review_statuses(examples: DataFrame) -> DataFrame:
    """status and n of the reviews among the examples; unparsed without a JSON object, None without a status."""
    return examples.where("category = 'sec'").groupBy(_review_status("messages").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def dataset_rules(examples: DataFrame) -> DataFrame:
    """L4, S6 and S7 over the whole dataset: code, subject, value, ok."""
    loops = examples.where("category = 'loop'").select(_gives_up("messages").alias("g")).agg(F.avg(F.col("g").cast("double")).alias("value"))
    l4 = loops.select(F.lit("L4").alias("code"), F.lit("give-up share").alias("subject"), "value", F.coalesce(F.col("value") >= GIVE_UP_SHARE, F.lit(True)).alias("ok"))
    reviews = examples.where("category = 'sec'").select("id", _review("messages").alias("r")).select("id", "r.status", "r.types")
    share = reviews.where("status in ('PASS', 'REJECT')").agg(F.avg(F.expr("cast(status = 'PASS' as double)")).alias("value"))
    s6 = share.select(F.lit("S6").alias("code"), F.lit("PASS share").alias("subject"), "value", F.coalesce(F.col("value").between(*PASS_WINDOW), F.lit(True)).alias("ok"))

    def family(name: str) -> Column:
        has = F.exists("types", lambda x: (x == name) | x.startswith(name + "_") | (x.startswith("a0") if name == "owasp" else F.lit(False)))
        return F.struct(F.lit(name).alias("family"), has.alias("has"))

    families = F.array(*map(family, REQUIRED_TYPES))
    covered = reviews.where("status = 'REJECT'").select(F.inline(families)).groupBy("family").agg(F.count_if("has").alias("n"))
    wanted = examples.sparkSession.createDataFrame([(t,) for t in REQUIRED_TYPES], "family string")
    s7 = wanted.join(covered, "family", "left").select(F.lit("S7").alias("code"), F.col("family").alias("subject"), F.coalesce("n", F.lit(0)).cast("double").alias("value"), (F.coalesce("n", F.lit(0)) >= MIN_PER_TYPE).alias("ok"))
    return l4.unionByName(s6).unionByName(s7)


def registry_tools() -> str:
    """The tool registry as the canonical JSON that examples without tools of their own get."""
    spec = [{"name": n, "parameters": {p: {"type": k, "required": r} for p, (k, r) in ps.items()}} for n, ps in TOOLS.items()]
    return json.dumps(spec, sort_keys=True, ensure_ascii=False)


def with_tools(examples: DataFrame) -> DataFrame:
    """Tool and loop examples without tools, or with an empty list of them, get the registry's."""
    none = F.col("tools").isNull() | F.regexp_replace("tools", r"\s", "").isin("", "[]", "null")
    return examples.withColumn("tools", F.when(none & F.col("category").isin("tool", "loop"), F.lit(registry_tools())).otherwise(F.col("tools")))
