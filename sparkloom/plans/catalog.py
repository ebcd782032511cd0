"""All queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.secrets import REDACT, SCAN, found_secrets, redact, redact_json, redaction_audit, redaction_count
from sparkloom.functions.text import content_hash, md5_bucket, normalize, prompt_key
from sparkloom.functions import templates
from sparkloom.functions.tokens import piece_ends, rendered, token_count
from sparkloom.operators import dataset, evaluation, listing, preflight, revisions, rules, sessions, similarity, split, workflow
from sparkloom.schema import CASE_PRIORITY, GATES, TOKEN_EDGES
from sparkloom.streaming import cases

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The driver's tables in the engine's roles: documents are examples (lang: category, source: group), labels their
# status, benchmark the evaluation cases, conversations messages, events the activity log of user sessions.
def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case event_type when 'error' then 'circuit_breaker' when 'click' then 'tool_call' when 'view' then 'tool_result' when 'purchase' then 'outcome' else 'message' end"
    return _table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id as session_id", "ts", "concat('m', user_id % 3) as model_version", f"{kind} as event", "props as data", "value")


# The activity log with data such as agents write, by the number k in the properties: sessions are the days of users of one remainder.
_AGENT = """case event_type when 'error' then case when k % 6 = 0 then 'circuit_breaker' when k % 6 = 1 then 'cancel' else 'message' end when 'click' then 'tool_call'
when 'view' then 'tool_result' when 'purchase' then 'outcome' else case when k % 5 = 0 then 'override' else 'verdict' end end as event,
case event_type when 'click' then case when k % 10 = 0 then '{"name": ""}' when k % 10 = 5 then '{"name": "t1", "arguments": [1]}' else concat('{"name": "t', k % 2, '", "arguments": {"p": ', k % 3, '}}') end
when 'view' then case when k % 2 = 0 then concat('{"error": "boom ', k, '"}') else '{"content": "fine"}' end
when 'error' then case when k % 6 > 3 then concat('{"role": "assistant", "name": "t', k % 2, '", "arguments": {"p": ', k % 3, '}}') when k % 6 = 3 then '{"role": "assistant", "content": "I stop"}' else '{"role": "user"}' end
when 'purchase' then concat('{"success": ', case when k % 2 = 0 then 'true' else 'false' end, ', "duration_ms": ', k, '}')
when 'signup' then case when k % 5 = 0 then '{"confirmed_safe": true}' when k % 2 = 0 then '{"verdict": "PASS"}' else '{"verdict": "REJECT"}' end else '{}' end as data"""
_AGT = f"(select event_id as id, concat(user_id % 20, '-', day(ts)) as session_id, ts, concat('m', user_id % 20 % 3) as model_version, {_AGENT} from (select *, (props::json->>'k')::integer as k from events))"


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    event, data = _AGENT.split(" as event,")
    return rows.selectExpr("event_id as id", "concat(user_id % 20, '-', day(ts)) as session_id", "ts", "concat('m', user_id % 20 % 3) as model_version", f"{event} as event", data)


_BUCKET = "(" + " + ".join(f"('0x' || substr(md5(session_id), {8 * k + 1}, 8))::bigint * {pow(96, 3 - k, 100)}" for k in range(4)) + ") % 100"
_CALL = "(data::json->>'name') || chr(31) || coalesce((data::json->'arguments')::varchar, '')"
_BY_TIME = "(partition by session_id order by ts, id)"
_RECOVERED = f"""
n as (select *, row_number() over {_BY_TIME} as n, case when event = 'tool_result' and data like '%error%' then 'error' when event = 'tool_call' then 'call' end as kind from {_AGT}),
k as (select *, lead(kind) over {_BY_TIME} as next_kind, lead(n) over {_BY_TIME} as next_n from n where kind is not null),
recovered as (select * from k where kind = 'error' and next_kind = 'call' and next_n - n <= 3)"""
_REPEATED = f"repeated as (select * from (select *, lag({_CALL}) over {_BY_TIME} as b, {_CALL} as c from {_AGT} where event = 'tool_call') where b = c)"
_UNCHANGED = f"""
around as (select *, last_value(case when event = 'tool_call' then {_CALL} end ignore nulls) over (partition by session_id order by ts, id rows between unbounded preceding and 1 preceding) as b,
first_value(case when event = 'message' and data::json->>'role' = 'assistant' then coalesce({_CALL}, '') end ignore nulls) over (partition by session_id order by ts, id rows between 1 following and unbounded following) as f from {_AGT}),
unchanged as (select * from around where event = 'tool_result' and data::json->>'error' is not null and b = f)"""

_ACT = "(select event_id as id, user_id as session_id, ts, 'm' || (user_id % 3) as model_version, case event_type when 'error' then 'circuit_breaker' when 'click' then 'tool_call' when 'view' then 'tool_result' when 'purchase' then 'outcome' else 'message' end as event, props as data, value from events)"
_NORM = r"trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x85\xA0\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+', ' ', 'g'))"
_GRAMS = "case when length(t) = 0 then [] when length(t) <= 5 then [t] else list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) end"
_OVERLAP = f"""
d as (select doc_id, {_GRAMS} as g from (select doc_id, {_NORM} as t from documents)),
b as (select item_id, {_GRAMS} as g from (select item_id, {_NORM} as t from benchmark)),
dg as (select doc_id, len(g) as n_doc, unnest(g) as gram from d), bg as (select item_id, len(g) as n_eval, unnest(g) as gram from b),
o as (select doc_id, item_id, n_doc, n_eval, count(*) as common from dg join bg using (gram) group by all)"""


@_query(f"with {_OVERLAP} select doc_id, item_id, common, n_doc + n_eval - common as n_union from o where common >= 0.3::double * (n_doc + n_eval - common)")
def contamination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against evaluation cases by Jaccard similarity of 5-grams."""
    out = similarity.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "common", F.col("n_union").cast("long").alias("n_union"))


@_query(f"with {_OVERLAP} select doc_id, item_id, common, n_eval from o where common >= 0.9::double * n_eval")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of an evaluation case."""
    out = similarity.containment(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "common", F.col("n_eval").cast("long").alias("n_eval"))


@_query(f"with {_OVERLAP} select doc_id, lang from documents where doc_id not in (select doc_id from o where common >= 0.3::double * (n_doc + n_eval - common))")
def decontaminated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hit = similarity.contamination(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select("doc_id", "lang").join(hit, "doc_id", "left_anti")


@_query("select sha256(text) as content_hash, min(doc_id) as first_id, count(*) as members from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents."""
    return similarity.exact_groups(_table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256)), "content_hash", "doc_id")


@_query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as k from documents) where k = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal contents stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return similarity.first_wins(docs, "h", "doc_id").select("doc_id")


@_query("select doc_id from (select doc_id, count(*) over (partition by text) as n from documents) where n = 1")
def dedup_drop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 at dataset build: every member of a set of equal contents goes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return similarity.drop_all(docs, "h").select("doc_id")


@_query(f"""
with t as (select {_NORM} as t, min(doc_id) as id from documents group by 1), s as (select id, {_GRAMS} as g from t), n as (select id, len(g) as n, unnest(g) as gram from s),
c as (select gram, count(*) as df from n group by 1), p as (select id, n, gram, df, row_number() over (partition by id order by df, gram) as k from n join c using (gram)),
f as (select * from p where k <= n - ceil(0.85::double * n) + 1 and df > 1),
pairs as (select distinct a.id as x, b.id as y from f a join f b on a.gram = b.gram and a.id < b.id where least(a.n, b.n) >= 0.85::double * greatest(a.n, b.n)),
o as (select x, y, len(list_intersect(a.g, b.g)) as common, len(a.g) + len(b.g) as both_n from pairs join s a on a.id = x join s b on b.id = y)
select x as first_id, y as second_id, common, both_n - common as n_union from o where common >= 0.85::double * (both_n - common)""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact similarity self-join with a prefix filter; near_duplicate_members names the copies of a text."""
    return similarity.near_duplicates(_table(spark, sf_dir, "documents"))


@_query(f"with t as (select doc_id, {_NORM} as t from documents) select doc_id, min(doc_id) over (partition by t) as first_id from t where t <> ''")
def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that stands for each document in near_duplicate_pairs."""
    return similarity.with_first(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("select lang, count(*) as docs, count(distinct text) as distinct_texts, count(*) - count(distinct text) as surplus_copies, sum(n_chars)::bigint as chars from documents group by 1")
def curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n = F.countDistinct(F.sha2("text", 256))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), n.alias("distinct_texts"), (F.count(F.lit(1)) - n).alias("surplus_copies"), F.sum("n_chars").alias("chars"))


_SPLIT = """
g as (select lang, source, count(*) as n, sha256('42|' || lang || '|' || source) as o from documents group by 1, 2),
w as (select *, sum(n) over (partition by lang) as total, count(*) over (partition by lang) as groups, coalesce(sum(n) over (partition by lang order by o, source rows between unbounded preceding and 1 preceding), 0) as before from g),
s as (select lang, source, case when groups > 1 and total > 1 and before < greatest(1, round_even(total * 0.1::double, 0)) then 'val' else 'train' end as split from w)"""


@_query(f"with {_SPLIT} select doc_id, lang, source, split from documents join s using (lang, source)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole groups, stratified, in seeded order."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return split.group_split(docs, id_col="doc_id", stratum="lang", group="source")


@_query(_FOUND["group_split"][1].replace("select doc_id, lang, source, split from documents", "select lang, split, count(*) as n from documents") + " group by 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split and stratum."""
    return split.split_counts(group_split(spark, sf_dir), "lang")


@_query(f"with {_SPLIT} select source from s group by 1 having count(distinct split) > 1")
def leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups on both sides of a split that isolates them within each language only."""
    return split.leaking_groups(group_split(spark, sf_dir), "source")


_SCANS = ", ".join(f"regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}') as p{k}" for k, p in enumerate(SCAN.values()))
_NAMES = ", ".join(f"case when p{k} then '{n}' end" for k, n in enumerate(SCAN))


@_query(f"select page_id, array_to_string(list_filter([{_NAMES}], lambda x: x is not null), ',') as secrets from (select page_id, {_SCANS} from pages)")
def page_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the secret patterns in a text."""
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(found_secrets(F.col("html")), ",").alias("secrets"))


def _redact_sql(col: str) -> str:
    for p, to in REDACT:
        col = f"regexp_replace({col}, '(?i){p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return col


@_query(f"select doc_id, md5(r) as redacted_md5, length(r) as n_chars from (select doc_id, {_redact_sql('text')} as r from documents)")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered redaction."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.md5("r").alias("redacted_md5"), F.char_length("r").cast("long").alias("n_chars"))


_COUNTED = "s0 as (select doc_id, lang, text as t, 0 as n from documents)" + "".join(
    f", s{k + 1} as (select doc_id, lang, regexp_replace(t, '{p}', '{to}', 'g') as t, n + len(regexp_extract_all(t, '{p}')) as n from s{k})" for k, (p, to) in enumerate(("(?i)" + p.replace("'", "''"), to) for p, to in REDACT)
)


@_query(f"with {_COUNTED} select lang, sum(n)::bigint as redactions, count(*) filter (n > 0) as docs from s{len(REDACT)} group by 1")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that redaction replaces, by language."""
    docs = _table(spark, sf_dir, "documents").select("lang", redaction_count(F.col("text")).alias("c"))
    return docs.groupBy("lang").agg(F.sum("c").cast("long").alias("redactions"), F.count_if(F.col("c") > 0).alias("docs"))


_AUDITED = " union all ".join(
    f"select doc_id, '{to}' as placeholder, list_filter(regexp_extract_all(t, '(?i){p.replace(chr(39), chr(39) * 2)}', {min(1, re.compile(p).groups)}), lambda m: m <> '')[1] as m from s{k}" for k, (p, to) in enumerate(REDACT)
)


@_query(f"with {_COUNTED} select doc_id, placeholder, substr(sha256(m), 1, 12) as digest from ({_AUDITED}) where m is not null")
def redaction_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit map of redacted texts, an entry a row."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(redaction_audit(F.col("text"))).alias("placeholder", "digest"))


@_query("select model_version, count(distinct session_id) as sessions, count(*) filter (event = 'circuit_breaker') as breakers, count(*) filter (event = 'circuit_breaker') / count(distinct session_id) as breaker_rate from " + _ACT + " group by 1")
def circuit_breaker_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    act = _activity(spark, sf_dir)
    n, c = F.countDistinct("session_id"), F.count_if(F.col("event") == "circuit_breaker")
    return act.groupBy("model_version").agg(n.alias("sessions"), c.alias("breakers"), (c / n).alias("breaker_rate"))


@_query(f"with {_RECOVERED}, r as (select model_version, count(*) as n from recovered group by 1) select model_version, calls, errors, coalesce(errors / nullif(calls, 0), 0) as error_rate, case when errors = 0 then 1 else coalesce(r.n, 0) / errors end as recovery_rate from (select model_version, count(*) filter (event = 'tool_call') as calls, count(*) filter (event = 'tool_result' and data like '%error%') as errors from {_AGT} group by 1) left join r using (model_version)")
def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    return sessions.reliability(_agents(spark, sf_dir)).select("model_version", "calls", "errors", "error_rate", "recovery_rate")


@_query("select model_version, count(*) filter (event = 'outcome') as successes, count(distinct session_id) as sessions, (sum(cast(value as decimal(18, 2))) filter (event = 'outcome'))::double as total_value from " + _ACT + " group by 1")
def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by model."""
    act = _activity(spark, sf_dir)
    total = F.sum(F.when(F.col("event") == "outcome", F.col("value").cast("decimal(18,2)"))).cast("double")
    return act.groupBy("model_version").agg(F.count_if(F.col("event") == "outcome").alias("successes"), F.countDistinct("session_id").alias("sessions"), total.alias("total_value"))


@_query(f"with {_RECOVERED} select id, session_id from recovered")
def recoveries_within_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error and the next call at most three rows later."""
    return sessions.recoveries(_agents(spark, sf_dir)).select("id", "session_id")


@_query(f"with {_REPEATED} select id, session_id from repeated")
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that repeats the one before."""
    return sessions.repeated_calls(_agents(spark, sf_dir)).select("id", "session_id")


@_query(f"with {_UNCHANGED} select id, session_id from unchanged")
def unchanged_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error whose next call equals the one before it."""
    return sessions.unchanged_after_error(_agents(spark, sf_dir)).select("id", "session_id")


@_query(f"""
with a as (select *, last_value(case when event = 'tool_call' then id end ignore nulls) over (partition by session_id order by ts, id rows between unbounded preceding and 1 preceding) as call_before,
first_value(case when event = 'tool_call' then id end ignore nulls) over (partition by session_id order by ts, id rows between 1 following and unbounded following) as call_after from {_ACT})
select id, call_before, call_after from a where event = 'circuit_breaker'""")
def error_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 as-of join: an error with the call before and the call after."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    call = F.when(F.col("event") == "tool_call", F.col("id"))
    rows = _activity(spark, sf_dir).withColumn("call_before", F.last(call, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("call_after", sessions.next_of(call))
    return rows.where("event = 'circuit_breaker'").select("id", "call_before", "call_after")


@_query("select distinct user_id as session_id from events where (md5_number(user_id::varchar) % 100) >= 0 and (" + " + ".join(f"('0x' || substr(md5(user_id::varchar), {8 * k + 1}, 8))::bigint * {pow(96, 3 - k, 100)}" for k in range(4)) + ") % 100 / 100 <= 0.2")
def success_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions in the sampled md5 buckets."""
    return sessions.success_sample(_activity(spark, sf_dir).select("session_id").distinct())


@_query(f"select id, session_id from (select *, row_number() over (partition by session_id order by ts, id) as n from {_ACT}) where n <= 500")
def first_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 events of a session."""
    return sessions.first_events(_activity(spark, sf_dir)).select("id", "session_id")


_EDGES = ", ".join(f"({k}, {e})" for k, e in enumerate(TOKEN_EDGES))


@_query(f"with e(bucket, edge) as (values {_EDGES}), d as (select case when n_chars is null then -1 else (select count(*) from e where n_chars > edge) end as bucket from documents), all_b as (select unnest(range(-1, {len(TOKEN_EDGES) + 1})) as bucket) select cast(all_b.bucket as integer) as bucket, count(d.bucket) as n from all_b left join d using (bucket) group by 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by size bucket, empty buckets too; -1 holds the unknown sizes."""
    return listing.length_histogram(_table(spark, sf_dir, "documents"), "n_chars")


@_query("select lang, cast(quality as integer) as quality, count(*) as n, grouping(lang)::integer as all_langs, grouping(quality)::integer as all_qualities from documents left join labels using (doc_id) group by grouping sets ((lang), (quality), ())")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category and by status in one pass."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    out = rows.groupingSets([["lang"], ["quality"], []], "lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").cast("int").alias("all_langs"), F.grouping("quality").cast("int").alias("all_qualities"))
    return out


@_query("""
with s as (select lang as suite, count(*) as total, count(*) filter (quality = 1) as passed from documents join labels using (doc_id) group by 1),
w as (select *, passed / total as p, 1 + 1.96::double * 1.96 / total as denom, total::double as t from s)
select suite, total, passed, round(greatest(0, (p + 3.8416::double / (2 * t) - 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * t)) / t)) / denom), 6) as low,
round(least(1, (p + 3.8416::double / (2 * t) + 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * t)) / t)) / denom), 6) as high from w""")
def wilson_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of good documents."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("lang").alias("suite")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("passed"))
    low, high = evaluation.wilson(F.col("passed"), F.col("total"))
    return rows.select("suite", "total", "passed", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@_query("select doc_id, lang, source from documents where text ilike '%license%' and lang = 'en' order by n_chars desc, doc_id limit 20")
def list_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: filtered listing, one page."""
    docs = listing.matching(_table(spark, sf_dir, "documents"), {"lang": "en"}, "license", ("text",))
    return listing.page(docs, [F.desc("n_chars"), F.col("doc_id")], limit=20).select("doc_id", "lang", "source")


@_query("select count(*) as total from documents where text ilike '%license%' and lang = 'en'")
def list_examples_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: how many rows all pages of list_examples hold."""
    return listing.total(listing.matching(_table(spark, sf_dir, "documents"), {"lang": "en"}, "license", ("text",)))


@_query("""
select case when quality = 1 then 'approved' when toxic = 1 then 'rejected' else 'pending' end as case_type, count(*) as n from labels group by 1""")
def case_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by type, the most frequent first; labels stand for cases."""
    kind = F.expr("case when quality = 1 then 'approved' when toxic = 1 then 'rejected' else 'pending' end")
    return listing.case_types(_table(spark, sf_dir, "labels").select(kind.alias("case_type")))


_CASES = ("doc_id as case_id", "case when quality = 1 then 'approved' when toxic = 1 then 'rejected' else 'pending' end as status", "doc_id % 5 as priority", "doc_id % 7 as created_at")


@_query(f"select case_id, priority from (select {', '.join(_CASES)} from labels) where status = 'approved' order by priority desc, created_at, case_id limit 100")
def approved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approved cases of highest priority; labels stand for cases."""
    return listing.approved_cases(_table(spark, sf_dir, "labels").selectExpr(*_CASES), 100).select("case_id", "priority")


@_query("select 'total' as kind, '' as value, count(*) as n from documents union all select 'by_category', lang, count(*) from documents group by lang union all select 'by_source', source, count(*) from documents group by source union all select 'by_language', lang, count(*) from documents where n_chars > 1000 group by lang")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by category, source and what their metadata say."""
    meta = F.to_json(F.struct(F.lit("").alias("language"), F.when(F.col("n_chars") > 1000, F.col("lang")).alias("lang")))
    return listing.distribution(_table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), "source", meta.alias("meta")))


@_query("select lang, sum(n_chars * case lang when 'en' then 2.5 when 'de' then 0.15 else 1.0 end + 10 * case lang when 'en' then 10.0 when 'de' then 0.6 else 3.0 end)::double / 1000000 as dollars from documents group by 1")
def estimated_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars by language, where a language stands for a model and texts for prompts of ten answer tokens."""
    model = F.expr("case lang when 'en' then 'gpt-4o' when 'de' then 'gpt-4o-mini' else lang end")
    rows = _table(spark, sf_dir, "documents").select("lang", (1_000_000 * listing.estimated_cost(model, F.col("n_chars"), F.lit(10))).cast("decimal(20,4)").alias("c"))
    return rows.groupBy("lang").agg((F.sum("c").cast("double") / 1_000_000).alias("dollars"))


@_query("select event_id, ts::varchar as ts from (select * from events where event_type = 'error' and user_id % 3 = 1 order by ts desc, event_id desc limit 50)")
def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: filtered events, newest first."""
    rows = _table(spark, sf_dir, "events").where("event_type = 'error' and user_id % 3 = 1").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return rows.select("event_id", F.col("ts").cast("string").alias("ts"))


@_query("select lang, arg_max(doc_id, n_chars * 1000000000 - doc_id) as longest_id, max(n_chars) as longest, count(*) filter (n_chars > 8192) as over_limit from documents group by 1")
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest size, where, and how many are too long."""
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest_id"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 8192).alias("over_limit"))


@_query("""
with m as (select conv_id, row_number() over w as k, role, lag(role) over w as before, first_value(role) over w as opening, count(*) over (partition by conv_id) as n, text from conversations window w as (partition by conv_id order by turn))
select conv_id, sum((k > 1 and role in ('user', 'assistant') and role = before)::integer + (k > 1 and role = 'system' and opening = 'system')::integer + (k = n and role <> 'assistant')::integer + (role = 'tool' and coalesce(before, '') not in ('assistant', 'tool'))::integer)::bigint as role_errors,
sum((trim(text) = '')::integer)::bigint as empty_errors, not bool_or(role = 'assistant') as no_assistant from m group by 1""")
def conversation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C3 over conversations."""
    found = _conversations(spark, sf_dir).select("conv_id", rules.structure(F.col("messages"), F.lit(None).cast("string")).alias("v"))
    count = lambda code: F.size(F.filter("v", lambda x: x["code"] == code)).cast("long")
    return found.select("conv_id", count("C1").alias("role_errors"), count("C2").alias("empty_errors"), (count("C3") > 0).alias("no_assistant"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@_query(r"""
select conv_id, sha256('{"messages": [' || string_agg('{"content": "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '", "role": "' || role || '"}', ', ' order by turn) || '], "tools": null}') as content_hash from conversations group by 1""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: hash of an example's canonical JSON."""
    return _conversations(spark, sf_dir).select("conv_id", content_hash(F.col("messages")).alias("content_hash"))


@_query("select event_type, count(*) as n, sum((props::json->>'k')::bigint)::bigint as k_total from events group by 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: values inside JSON."""
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_total"))


@_query(f"select md5({_NORM}) as norm_md5, count(*) as n from documents group by 1")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text."""
    return _table(spark, sf_dir, "documents").groupBy(F.md5(normalize(F.col("text"))).alias("norm_md5")).agg(F.count(F.lit(1)).alias("n"))


@_query("select 'v' || lpad((max(doc_id) + 1)::varchar, 4, '0') as next_id from documents")
def next_version_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D26."""
    return split.next_version(_table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), F.col("doc_id")).alias("id")))


@_query("select count(*) filter (quality = 1) as approved, count(*) filter (quality = 1) >= 150 as ready from labels")
def feedback_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D23."""
    n = F.count_if(F.col("quality") == 1)
    return _table(spark, sf_dir, "labels").agg(n.alias("approved"), (n >= 150).alias("ready"))


_PRIORITY = " ".join(f"when '{k}' then {v}" for k, v in CASE_PRIORITY.items())


@_query(f"""
with {_REPEATED}, {_UNCHANGED}, a as (select *, bool_or(event = 'outcome' and data::json->>'success' = 'false') over (partition by session_id) as failed, bool_or(event = 'override') over (partition by session_id) as safe from {_AGT}),
once as (select distinct session_id, model_version, case_type, signal from (select *, 'loop' as case_type, 'circuit_breaker' as signal from a where event = 'circuit_breaker'
union all by name select *, 'loop' as case_type, 'repeated_call' as signal from repeated union all by name select *, 'syntax' as case_type, 'malformed_call' as signal from a where event = 'tool_call' and (data::json->>'name' = '' or coalesce(json_type(data::json->'arguments'), '') <> 'OBJECT')
union all by name select *, 'loop' as case_type, 'unchanged_after_error' as signal from unchanged union all by name select *, 'cancel' as case_type, 'cancelled' as signal from a where event = 'cancel')),
cases as (from once union all select session_id, model_version, 'false_negative', 'pass_then_failed' from a where event = 'verdict' and data::json->>'verdict' = 'PASS' and failed
union all select session_id, model_version, 'false_positive', 'reject_confirmed_safe' from a where event = 'verdict' and data::json->>'verdict' = 'REJECT' and safe),
every as (from cases union all select distinct session_id, model_version, 'success', 'clean' from a where session_id not in (select session_id from cases) and {_BUCKET} / 100 <= 0.2)
select *, case case_type {_PRIORITY} end::integer as priority from every""")
def mined_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure cases of all sessions."""
    return sessions.detect_cases(_agents(spark, sf_dir))


@_query(_FOUND["mined_cases"][1])
def streamed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 with since as a stream: the log in four batches, events up to two hours late, sessions searched whenever they are quiet for an hour."""
    return cases.replayed(_agents(spark, sf_dir), "ts + make_interval(0, 0, 0, 0, cast(crc32(cast(id as string)) % 3 as int))", late="4 hours", quiet="1 hour", forget="3 days")


@_query(f"""
with {_RECOVERED}, r as (select model_version, count(*) as n from recovered group by 1), j as (select *, data::json as d from {_AGT}),
b as (select model_version, count(distinct session_id) as sessions, count(*) filter (event = 'circuit_breaker') as breakers, count(*) filter (event = 'tool_call') as calls, count(*) filter (event = 'tool_result' and data like '%error%') as errors,
count(*) filter (d->>'verdict' = 'PASS') as passes, count(*) filter (d->>'verdict' = 'REJECT') as rejects, count(*) filter (d->>'success' = 'false') as failed, count(*) filter (d->>'success' = 'true') as succeeded,
count(*) filter (d->>'confirmed_safe' = 'true') as confirmed_safe, avg((d->>'duration_ms')::double) as mean_ms from j group by 1)
select b.* replace (nullif(mean_ms, 0) as mean_ms), coalesce(n, 0) as recovered, coalesce(breakers / nullif(sessions, 0), 0) as breaker_rate, coalesce(errors / nullif(calls, 0), 0) as error_rate, case when errors = 0 then 1 else coalesce(n, 0) / errors end as recovery_rate,
coalesce(failed / nullif(passes, 0), 0) as false_negative_rate, coalesce(confirmed_safe / nullif(rejects, 0), 0) as false_positive_rate, coalesce(succeeded / nullif(sessions, 0), 0) as success_rate from b left join r using (model_version)""")
def model_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 to D4 in one frame, with recoveries."""
    return sessions.reliability(_agents(spark, sf_dir))


@_query(None)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C6 and P1 to P4 over conversations as examples. No table holds tool, loop or review examples: T, L and S rules and dataset_rules run in no query."""
    import public_tokenizers

    rows = _conversations(spark, sf_dir).select(F.col("conv_id").cast("string").alias("id"), F.lit("plan").alias("category"), "messages", F.lit(None).cast("string").alias("tools")).withColumn("content_hash", content_hash(F.col("messages")))
    tokens = token_count(rendered(F.col("messages"), F.col("tools")), public_tokenizers.path("word_bpe_49k.json"))
    return rules.report(rows, rules.validate(rows.withColumn("tokens", tokens), tokens_col="tokens"))


@_query("select event_type, count(*) filter (json_valid(props) and json_type(props) = 'OBJECT') as valid, count(*) as n from events group by 1")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: which event properties are strict JSON objects."""
    rows = _table(spark, sf_dir, "events").select("event_type", evaluation.valid_json(F.col("props")).alias("ok"))
    return rows.groupBy("event_type").agg(F.count_if("ok").alias("valid"), F.count(F.lit(1)).alias("n"))


@_query("with b as (select event_type as gate, 100.0::double * count(*) filter (value > 5) / count(*) as value from events group by 1) select 'click' as gate, (select value from b where gate = 'click') >= 50 as passed union all select 'missing', false")
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates against thresholds; a gate without a value fails."""
    values = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("gate")).agg((100.0 * F.count_if(F.col("value") > 5) / F.count(F.lit(1))).alias("value"))
    limits = spark.createDataFrame([("click", 50.0), ("missing", 0.0)], "gate string, low double")
    return limits.join(values, "gate", "left").select("gate", F.coalesce(F.col("value") >= F.col("low"), F.lit(False)).alias("passed"))


@_query("select doc_id, cast((" + " + ".join(f"('0x' || substr(md5(doc_id::varchar), {8 * k + 1}, 8))::bigint * {pow(96, 3 - k, 100)}" for k in range(4)) + ") % 100 as bigint) as bucket from documents")
def md5_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", md5_bucket(F.col("doc_id").cast("string")).alias("bucket"))


@_query("""
with m as (select conv_id, turn, role, row_number() over w - 1 as k, length(coalesce(role, '')) + length(coalesce(text, '')) + 24 as size from conversations window w as (partition by conv_id order by turn, role, text)),
p as (select *, sum(size) over (partition by conv_id order by k) as stop from m)
select conv_id, k::integer as turn, (stop - size)::bigint as start, stop::bigint as stop from p where role = 'assistant'""")
def loss_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assistant turns add to the rendered conversation, counted in characters."""
    rows = _conversations(spark, sf_dir).select(F.col("conv_id").alias("id"), "messages", F.lit("").alias("tools"))
    return preflight.assistant_spans(rows, piece_ends).withColumnRenamed("id", "conv_id")


# Tools of every second conversation; every fourth turn is a tool's.
_TOOLS = """[{"type": "function", "function": {"name": "read_file", "description": "Reads a file.", "parameters": {"type": "object", "properties": {"path": {"type": "string", "description": " where "}, "n": {"type": ["integer", "string"]}, "tags": {"type": "array", "items": {"type": "string"}}, "env": {"type": "object", "additionalProperties": {"type": "number"}}}, "required": ["path"]}}}]"""
_SIGNATURE = """{"type": "function", "function": {"name": "read_file", "description": "read_file(path: str, n: Union[int,str], tags: list[Union[]], env: dict[str, float]) - Reads a file.

    Args:
        path(str): where        n(Union[int,str]):         tags(list[Union[]]):         env(dict[str, float]): ", "parameters": {"type": "object", "properties": {"path": {"type": "string", "description": " where "}, "n": {"type": ["integer", "string"]}, "tags": {"type": "array", "items": {"type": "string"}}, "env": {"type": "object", "additionalProperties": {"type": "number"}}}, "required": ["path"]}}"""
_RENDERED = f"""
m as (select conv_id, row_number() over w as k, count(*) over (partition by conv_id) as n, case when row_number() over w % 4 = 3 then 'tool' else coalesce(role, '') end as role, coalesce(text, '') as text from conversations window w as (partition by conv_id order by turn, role, text)),
b as (select *, coalesce(lag(role) over (partition by conv_id order by k), '') as before, coalesce(lead(role) over (partition by conv_id order by k), '') as after, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as plain from m),
q as (select conv_id, k, conv_id % 2 = 0 as tools, case when k = 1 and role = 'system' then text end as own, plain,
case when role = 'user' or role = 'assistant' or (role = 'system' and k > 1) then plain when role = 'tool' then case when before <> 'tool' then '<|im_start|>user' else '' end || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || case when after <> 'tool' then '<|im_end|>' || chr(10) else '' end else '' end as qwen,
case when role in ('user', 'system', 'assistant') then plain when role = 'tool' then case when k > 1 and before <> 'tool' then '<|im_start|>tool' || chr(10) else '' end || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || case when k = n then '<|im_end|>' else chr(10) || case when after <> 'tool' then '<|im_end|>' else '' end end else '' end as hermes from b),
r as (select conv_id, string_agg(plain, '' order by k) as chatml,
'<|im_start|>system' || chr(10) || coalesce(max(own), 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.') || case when any_value(tools) then $a${templates.QWEN_TOOLS}
{_TOOLS[1:-1]}{templates.QWEN_CALLS}$a$ else '<|im_end|>' || chr(10) end || string_agg(qwen, '' order by k) as qwen,
'<|begin_of_text|>' || case when any_value(tools) then $a$<|im_start|>system
{templates.HERMES_TOOLS}{_SIGNATURE}{templates.HERMES_SCHEMA}{templates.HERMES_CALLS}$a$ || string_agg(hermes, '' order by k) else string_agg(plain, '' order by k) end as hermes from q group by 1)"""


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform("messages", lambda m, i: F.struct(F.when(i % 4 == 2, F.lit("tool")).otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    return _conversations(spark, sf_dir).select("conv_id", turns.alias("messages"), F.when(F.col("conv_id") % 2 == 0, F.lit(_TOOLS)).alias("tools"))


@_query(f"with {_RENDERED} select conv_id, case when conv_id % 2 = 0 then 'tool_use' else 'default' end as template, sha256(qwen) as qwen_sha256, length(qwen) as qwen_chars, sha256(hermes) as hermes_sha256, length(hermes) as hermes_chars from r")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the chat templates of both model families render them, with tools and tool answers."""
    rows = _dialogues(spark, sf_dir)
    out = rows.select("conv_id", templates.pick_template(F.col("tools")).alias("template"), *(templates.render(F.col("messages"), F.col("tools"), adapter=a).alias(n) for a, n in (("qwen25", "qwen"), ("hermes2pro", "hermes"))))
    return out.select("conv_id", "template", *(f(F.col(n)).alias(f"{n}_{x}") for n in ("qwen", "hermes") for x, f in (("sha256", lambda c: F.sha2(c, 256)), ("chars", F.char_length))))


@_query(f"""with {_RENDERED},
p as (select conv_id, chatml as a, case when conv_id % 3 = 0 then chatml else hermes end as b from r)
select conv_id, a = b as same, case when a <> b then (select min(i) - 1 from range(1, greatest(strlen(a), strlen(b)) + 2) t(i) where coalesce(substr(a, i, 1), '') <> coalesce(substr(b, i, 1), '')) end::integer as first_byte from p""")
def template_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8c/PF2: two renderings of a conversation, and the first byte at which they part."""
    rows = _dialogues(spark, sf_dir)
    a, b = rendered(F.col("messages")), templates.render(F.col("messages"), F.col("tools"), adapter="hermes2pro")
    both = rows.select("conv_id", a.alias("a"), F.when(F.col("conv_id") % 3 == 0, a).otherwise(b).alias("b"))
    return templates.parity(both, "a", "b", keys=("conv_id",))


@_query("""
select source as run_id, bool_and(toxic = 0 or quality = 0) as can_proceed, bool_and(toxic = 0) as all_passed, coalesce(string_agg(distinct lang, ',' order by lang) filter (toxic = 1), '') as failed
from documents join labels using (doc_id) group by 1""")
def preflight_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the roll-up of checks; sources stand for runs, languages for checks, good documents for critical ones."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    found = preflight.rolled_up(rows.select(F.col("source").alias("run_id"), F.col("lang").alias("code"), (F.col("toxic") == 0).alias("passed"), (F.col("quality") == 1).alias("critical")))
    return found.withColumn("failed", F.array_join("failed", ","))


@_query("""
select doc_id, concat_ws(',', case when trim(source) = '' then 'run_name' end, case when lang not in ('en', 'de') then 'base_model' end, case when doc_id % 20 not in (1, 2, 4, 8, 16) then 'lora_r' end,
case when doc_id % 7 = 0 then 'seed' end, case when doc_id % 30 > 10 then 'lora_dropout' end, case when doc_id % 3 < 1 then 'epochs' end, case when n_chars < 256 then 'max_seq_length' end) as errors from documents""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a configuration that break a rule; documents stand for configurations."""
    configs = _table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source as run_name", "lang as base_model", "doc_id % 20 as lora_r", "doc_id % 7 as seed", "(doc_id % 30) / 10D as lora_dropout", "doc_id % 3 as epochs", "n_chars as max_seq_length"
    )
    return preflight.config_errors(configs, ["en", "de"]).select("doc_id", F.array_join("errors", ",").alias("errors"))


@_query("""
with c as (select substr(sha256(text), 1, 16) as key, max(doc_id) as doc_id from documents where doc_id % 2 = 0 group by 1)
select d.doc_id, 'r' || c.doc_id as result from documents d left join c on substr(sha256(d.text), 1, 16) = c.key""")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the key of a prompt, the newest of a key; even documents stand for the cache."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    cache = docs.where("doc_id % 2 = 0").select(prompt_key(F.col("prompt")).alias("key"), F.concat(F.lit("r"), "doc_id").alias("result"), F.col("doc_id").alias("at"))
    return listing.cached_results(docs, cache).select("doc_id", "result")


@_query("""
select case_id, status, reviewer, second_reviewer from (select doc_id as case_id, case when quality = 1 then 'pending' else 'approved' end as status, case toxic when 1 then 'sec' else 'loop' end as case_type,
case when doc_id % 3 > 0 then 'r' || doc_id % 3 end as reviewer, case when doc_id % 4 > 0 then 'r' || doc_id % 4 end as second_reviewer from labels)
where status = 'pending' and (case_type <> 'sec' or second_reviewer is not null and second_reviewer is distinct from reviewer)""")
def case_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: cases that may be approved; labels stand for cases."""
    cases = _table(spark, sf_dir, "labels").selectExpr(
        "doc_id as case_id", "if(quality = 1, 'pending', 'approved') as status", "if(toxic = 1, 'sec', 'loop') as case_type", "if(doc_id % 3 > 0, concat('r', doc_id % 3), null) as reviewer",
        "if(doc_id % 4 > 0, concat('r', doc_id % 4), null) as second_reviewer", "'{}' as edited_example_json",
    )
    return workflow.case_approvals(cases).select("case_id", "status", "reviewer", "second_reviewer")


@_query("""
with r as (select lang as suite, quality = 1 as passed, toxic = 0 as valid_json from documents join labels using (doc_id)),
two as (select suite, passed, valid_json from r union all select suite, passed and valid_json, valid_json from r)
select suite, count(*) as total, count(*) filter (passed) as passed, count(*) filter (valid_json) as valid_json from two group by 1""")
def combined_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two modes as one suite."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    raw = rows.select(F.col("lang").alias("suite"), F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("valid_json"))
    api = raw.withColumn("passed", F.col("passed") & F.col("valid_json"))
    return evaluation.suite_summary(evaluation.combined_modes(raw, api)).select("suite", "total", "passed", "valid_json")


@_query("select event_id, json_object('k', props::json->'k', 'ip', '[REDACTED_IP]') as redacted from events")
def redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values of JSON redacted, at any depth."""
    value = F.concat(F.lit('{"k":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(', "ip": "10.0.'), F.col("event_id") % 200, F.lit('.1"}'))
    out = _table(spark, sf_dir, "events").select("event_id", redact_json(value).alias("redacted"))
    return out.withColumn("redacted", F.replace(F.replace("redacted", F.lit('": '), F.lit('":')), F.lit(", "), F.lit(",")))


_MIX = {"en": 0.5, "de": 0.3, "fr": 0.2}


@_query(f"""with k as (select doc_id, lang, -ln((('0x' || substr(md5('7|' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double) / n_chars as k from documents),
q as (select lang, round_even(round_even((select count(*) from documents) * 0.1::double, 0) * case lang {" ".join(f"when '{k}' then {v}::double" for k, v in _MIX.items())} end, 0) as n from documents group by 1)
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by k, doc_id) as r from k where k is not null) join q using (lang) where r <= n""")
def seeded_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a tenth of the documents, half of it English, by length."""
    return split.seeded_mix(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _MIX, rate=0.1, stratum="lang", weight="n_chars", seed=7, id_col="doc_id").select("doc_id", "lang")


@_query("""with recursive o as (select user_id % 50 as key, event_id, value, row_number() over (partition by user_id % 50 order by event_id, value) as n from events),
r as (select key, n, event_id, case when value <= 100 then value else 0.0 end as spent, coalesce(value <= 100, false) as accepted from o where n = 1
union all select o.key, o.n, o.event_id, case when r.spent + o.value <= 100 then r.spent + o.value else r.spent end, coalesce(r.spent + o.value <= 100, false) from r join o on o.key = r.key and o.n = r.n + 1)
select key, event_id, accepted, floor(spent * 1000 + 0.5)::bigint as spent_milli from r""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events accepted in order within a budget of 100 for each of fifty payers."""
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), "event_id", "value")
    return evaluation.budget_scan(rows, "key", "event_id", "value", 100.0).select("key", "event_id", "accepted", F.floor(F.col("spent") * 1000 + 0.5).alias("spent_milli"))


@_query("""with l as (select lang as split, sha256(text) as h from documents),
a as (select split, h[1:6] as p, count(*) as n, sha256(string_agg(h, ',' order by h)) as hash from l group by 1, 2),
b as (select split, p[1:4] as p, sum(n) as n, sha256(string_agg(p || ':' || hash, ',' order by p)) as hash from a group by split, p[1:4]),
c as (select split, p[1:2] as p, sum(n) as n, sha256(string_agg(p || ':' || hash, ',' order by p)) as hash from b group by split, p[1:2])
select split, sum(n)::bigint as n, sha256(string_agg(p || ':' || hash, ',' order by p)) as hash from c group by split""")
def tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for the texts of each language, however they are stored."""
    return dataset.tree_hash(_table(spark, sf_dir, "documents"), "lang", "text")


# Events as judged responses: the kind is the suite, the value decides, the properties are the answer.
_SUITE = "case event_type when 'click' then 'tool_syntax' when 'view' then 'anti_loop' when 'purchase' then 'security_vuln' when 'signup' then 'security_clean' else 'plan_json' end"
_LIMITS = ", ".join(f"('{k}', {lo}::double, {'null' if hi is None else hi}::double)" for k, (lo, hi) in GATES.items())


@_query(f"""with r as (select {_SUITE} as suite, value > 5 as passed, coalesce(json_valid(props), false) as valid, value < 1 as fp from events),
s as (select suite, count(*) as total, count(*) filter (passed) as passed, count(*) filter (valid) as valid, count(*) filter (fp) as fp from r group by 1),
v as (select case suite when 'security_vuln' then 'security_catch' else suite end as gate, 100 * (passed / total) as value from s where suite <> 'security_clean'
union all select 'json_validity', 100 * sum(valid) / sum(total) from s where suite in ('security_vuln', 'security_clean', 'plan_json')
union all select 'security_fp', 100 * fp / total from s where suite = 'security_clean'
union all select 'regression', 100 * ((select passed / total from s where suite = 'anti_loop') / (select passed / total from s where suite = 'tool_syntax')))
select gate, low, high, v.value, coalesce(v.value >= low and (high is null or v.value <= high), false) as passed from (values {_LIMITS}) l(gate, low, high) left join v using (gate)""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of suites as gate values against all gates; speed and end_to_end have no value and fail."""
    rows = _table(spark, sf_dir, "events").select(F.expr(_SUITE).alias("suite"), (F.col("value") > 5).alias("passed"), evaluation.valid_json(F.col("props")).alias("valid_json"), (F.col("value") < 1).alias("false_positive"))
    summary = evaluation.suite_summary(rows)
    of = lambda suite, col: F.max(F.when(F.col("suite") == suite, F.col(col)))
    regression = summary.agg(of("anti_loop", "passed").alias("candidate_passed"), of("anti_loop", "total").alias("candidate_total"), of("tool_syntax", "passed").alias("base_passed"), of("tool_syntax", "total").alias("base_total"))
    return evaluation.gate_check(spark, evaluation.gate_values(summary, evaluation.false_positives(rows), regression=regression))


# Changes of clients as changes of examples: I creates, U updates or, every fifth, sets the status, D deletes.
_OP = "case when op = 'I' then 'create' when op = 'D' then 'delete' when op = 'U' and change_id % 5 = 0 then 'status' when op = 'U' then 'update' end"
_CHG = f"(select distinct client_id::varchar as id, change_id as n, {_OP} as op, segment, source, city from client_changes where client_id is not null and change_id is not null)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("if(city is null, null, array(struct('user' as role, coalesce(segment, '') as content), struct('assistant' as role, city as content)))")
    rows = _table(spark, sf_dir, "client_changes").distinct().select(
        F.col("client_id").cast("string").alias("id"), F.col("change_id").alias("n"), F.expr(_OP).alias("op"), F.col("segment").alias("category"), said.alias("messages"),
        F.lit(None).cast("string").alias("tools"), "source", F.col("city").alias("group_id"), F.lit("approved").alias("status"),
    )
    return rows.where("id is not null and n is not null")


@_query(f"""with c as {_CHG}, e as (select id, max(n) filter (op = 'delete') as stop from c group by 1),
a as (select c.* from c join e using (id) where op <> 'delete' and (stop is null or n > stop)), s as (select id, min(n) filter (op = 'create') as start from a group by 1),
r as (select a.* from a join s using (id) where n >= start and (op <> 'create' or n = start)),
l as (select id, arg_max(segment, n) filter (op <> 'status' and segment <> '') as category, arg_max(source, n) filter (op <> 'status' and source <> '') as source, arg_max(city, n) filter (op <> 'status' and city is not null) as group_id,
arg_max(coalesce(segment, ''), n) filter (op <> 'status' and city is not null) as said, max(case when op = 'status' then 'approved' end) as status from r group by 1)
select id, category, source, group_id, coalesce(status, 'draft') as status,
sha256('{{"messages": [{{"content": "' || said || '", "role": "user"}}, {{"content": "' || group_id || '", "role": "assistant"}}], "tools": null}}') as content_hash from l""")
def revised_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: the latest rows of a table of revisions after two commits of changes, the earlier half and the later."""
    rows = _changes(spark, sf_dir)
    middle = F.lit(rows.agg(F.max("n")).first()[0] or 0) / 2
    table = revisions.Table(spark, cases.shared_folder(spark, "examples"))
    for half in (F.col("n") <= middle, F.col("n") > middle):
        table.apply(rows.where(half))
    return table.rows().select("id", "category", "source", "group_id", "status", "content_hash")


@_query(f"""with c as {_CHG}, b as (select id, n, op, last_value(case when op in ('create', 'delete') then op end ignore nulls) over (partition by id order by n rows between unbounded preceding and 1 preceding) as before from c where op is not null)
select id, n, op, case when op = 'create' then 'exists' else 'missing' end as reason from b where (op = 'create') = (coalesce(before, 'delete') = 'create')""")
def refused_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: changes that find no row, and creations that find one."""
    rows = _changes(spark, sf_dir)
    return revisions.refused(spark.createDataFrame([], revisions.ROW), rows)


_SECRET = "(" + " or ".join(f"regexp_matches(asked, '{p.replace(chr(39), chr(39) * 2)}')" for p in SCAN.values()) + ")"
_BLANK = "trim(regexp_replace(coalesce({}, ''), '\\s+', '', 'g')) = ''"


@_query(f"""with asked as (select doc_id, lang, source, text as said, coalesce(lang || chr(10) || text, lang, text, '') as asked, count(*) over (partition by lang, text) as copies from documents where lang in ('en', 'de', 'fr')),
{_OVERLAP.replace("as t from documents", "as t from (select doc_id, asked as text from asked)").lstrip()},
kept as (select * from asked where (copies = 1 or lang is null or said is null) and not {_SECRET} and not {_BLANK.format("said")} and doc_id not in (select doc_id from o where common >= 0.3::double * (n_doc + n_eval - common))),
{_SPLIT.replace("from documents", "from kept").lstrip()}
select doc_id, lang, split from kept join s using (lang, source)""")
def next_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rows and splits of a version of three categories that judges only what the version before, of even ids, hasn't; documents stand for examples."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    rows = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), said.alias("messages"), F.lit(None).cast("string").alias("tools"), "source", F.col("source").alias("group_id"), F.lit("approved").alias("status"), "doc_id"
    )
    evals, (first, second) = _table(spark, sf_dir, "benchmark"), (cases.shared_folder(spark, "judged") for _ in range(2))
    dataset.build_next(rows.where("doc_id % 2 = 0"), evals, first, categories=["en", "de", "fr"])
    return dataset.build_next(rows, evals, second, first, categories=["en", "de", "fr"]).select("doc_id", F.col("category").alias("lang"), "split")


@_query(_FOUND["near_duplicate_pairs"][1].replace(", common, both_n - common as n_union from o", " from o"))
def near_duplicates_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 in steps: pairs of similar texts of all documents from the stored keys and pairs of the even ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    none = (spark.createDataFrame([], kind) for kind in (similarity.KEYS, similarity.PAIRS))
    stored = []
    for kind, found in zip(("keys", "pairs"), similarity.near_texts_next(docs.where("doc_id % 2 = 0"), *none), strict=True):
        folder = cases.shared_folder(spark, kind)
        found.write.parquet(folder)
        stored.append(spark.read.parquet(folder))
    pairs = similarity.near_texts_next(docs, *stored)[1]
    named = docs.groupBy(F.sha2(normalize(F.coalesce("text", F.lit(""))), 256).alias("h")).agg(F.min("doc_id").alias("id"))
    both = pairs.join(named.toDF("first_id", "a"), "first_id").join(named.toDF("second_id", "b"), "second_id")
    return both.select(F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
