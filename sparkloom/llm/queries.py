"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import change_feed, decontaminate, html_text, license_scan, minhash, preference, prefix_trie, segment, substring, token_output, toxicity, url_filter, vectors
from sparkloom.llm.store import scope, table

#: The rules of op6: verdict, host/path.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labels are learned only from these rows.
NOT_HELD_OUT = "pmod(crc32(cast(doc_id as string)), 3) <> 1"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.paired(preference.conversations(table(spark, sf_dir, "conversations"))))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_licenses", "n_sentences")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.build(spark, iter(URL_RULES)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=NOT_HELD_OUT)
    held_out = F.coalesce(F.expr(f"not ({NOT_HELD_OUT})"), F.lit(False))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark) as stay:
        found = prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))
        stay.append(found)
    return found


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.apply_changes(table(spark, sf_dir, "client_changes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_embedding_near_dedup, op2_sentencepiece_sampling, op3_token_output, op4_preference_format, op5_license_scan, op6_url_filter,
        op7_toxicity, op8_html_extraction, op9_decontamination, op10_minhash_near_dedup, op11_conversation_trie, op12_substring_dedup,
        op13_sequenced_changes,
    )
    return {f.__name__: f for f in found}


_RULES = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)

ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as u, b.vec_id as w from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(u, w) as (select u, w from links union select r.u, l.w from reach r join links l on r.w = l.u),
low as (select u, min(w) as low from reach group by u),
n as (select u, count(*) as n_links from links group by u)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join n on n.u = vec_id left join low on low.u = vec_id
""",
    "op4_preference_format": r"""
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as size from t),
opening as (select conv_id, min(conv_id) over (partition by role, text) as chosen_id from n where k = 1),
same as (select o.conv_id, a.k, coalesce(a.role = b.role and a.text = b.text, false) as same from opening o join n a on a.conv_id = o.chosen_id
         left join n b on b.conv_id = o.conv_id and b.k = a.k),
lcp as (select conv_id, coalesce(min(k) filter (not same) - 1, max(k)) as n_common from same group by conv_id),
lone as (select conv_id, coalesce(max(k) filter (role = 'assistant') - 1, max(k)) as n_common from n group by conv_id),
cut as (select o.conv_id, o.chosen_id, case when o.conv_id = o.chosen_id then lone.n_common else lcp.n_common end as n_common
        from opening o join lcp using (conv_id) join lone using (conv_id)),
out as (select conv_id, k, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s, length(role) + 13 as head from n),
side as (select c.conv_id, c.n_common, which, out.* exclude (conv_id), coalesce(sum(length(s)) over (partition by c.conv_id, which, k > n_common order by k rows between unbounded preceding and 1 preceding), 0) as pos
         from (select *, 'c' as which, chosen_id as id from cut union all select *, 'r', conv_id from cut where conv_id <> chosen_id) c join out on out.conv_id = c.id),
text as (select conv_id, which, coalesce(string_agg(s, '' order by k) filter (k <= n_common), '') as prompt, coalesce(string_agg(s, '' order by k) filter (k > n_common), '') as rest,
         coalesce(string_agg((pos + head)::bigint || '-' || (pos + length(s))::bigint, ',' order by k) filter (k > n_common and role = 'assistant'), '') as mask from side group by conv_id, which)
select c.conv_id, c.chosen_id, case when c.conv_id <> c.chosen_id then c.conv_id end as rejected_id, n_common, a.prompt, a.rest as chosen, a.mask as chosen_mask, b.rest as rejected, b.mask as rejected_mask
from cut c join text a on a.conv_id = c.conv_id and a.which = 'c' left join text b on b.conv_id = c.conv_id and b.which = 'r'
""",
    "op6_url_filter": rf"""
with rules(verdict, rule) as (values {_RULES}),
split as (select *, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules),
urls as (select page_id, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
p as (select page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path from urls),
fits as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p join split
         on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fits using (page_id)
""",
    "op9_decontamination": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item_id, w, least(len(w), 10) as n from bw where len(w) > 0),
win as (select distinct item_id, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as g from bs, unnest(range(1, len(w) - n + 2)) t(k)),
sizes as (select distinct n from win),
grams as (select doc_id, n, k, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as g from dw, sizes, unnest(range(1, len(w) - n + 2)) t(k)),
hits as (select doc_id, k, win.n, item_id from grams join win using (n, g)),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + n)) as j from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
""",
    "op10_minhash_near_dedup": r"""
with recursive dw as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents where text is not null),
g as (select doc_id, g, count(*) as c from (select doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') as g from dw, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) where len(w) > 0) group by all),
n as (select doc_id, sum(c) as n from g group by 1),
common as (select a.doc_id as u, b.doc_id as v, sum(least(a.c, b.c)) as common from g a join g b using (g) where a.doc_id < b.doc_id group by all),
one as (select u, v from common join n a on a.doc_id = u join n b on b.doc_id = v where common::double / (a.n + b.n - common) >= 0.8::double
        union all select a.doc_id, b.doc_id from dw a join dw b using (text) where len(a.w) = 0 and a.doc_id < b.doc_id),
links as (select u, v from one union all select v, u from one),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
low as (select u, min(v) as low from reach group by u)
select doc_id, least(doc_id, coalesce(low, doc_id)) as component_id, doc_id = least(doc_id, coalesce(low, doc_id)) as kept from documents left join low on low.u = doc_id
""",
    "op12_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, k, list_aggregate(w[k:k + 49], 'string_agg', ' ') as g from w, unnest(range(1, len(w) - 48)) t(k) where doc_id is not null),
least_ids as (select g, min(doc_id) as low from win group by g having min(doc_id) < max(doc_id)),
gone as (select doc_id, list_distinct(flatten(list(range(k, k + 50)))) as gone from win join least_ids using (g) where low < doc_id group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: not coalesce(list_contains(gone, i), false)), 'string_agg', ' '), '')) as kept_sha256
from w left join gone using (doc_id)
""",
    "op11_conversation_trie": r"""
with crc_table as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, b::bigint)) as t),
turn_rows as (select conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as digest, turn, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as k from turn_rows),
ids as (select conv_id, n, conv_id - conv_id % 100 as first_id,
        xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 6 as h
        from (select conv_id, count(*) as n from t group by 1), crc_table),
c as (select a.*, least(a.h, coalesce(b.n, 0)) as m from ids a left join ids b on b.conv_id = a.first_id),
r as (select c.conv_id, t.k as d, digest, chars from c join t on t.conv_id = c.first_id and t.k <= c.h union all
      select c.conv_id, m + t.k - h, digest, chars from c join t on t.conv_id = c.conv_id and t.k > c.h),
p as (select conv_id, 0 as d, '' as path, 0 as chars from c union all
      select conv_id, d, string_agg(digest, '') over (partition by conv_id order by d) as path, chars from r),
s as (select *, max(d) over (partition by conv_id) as size, lag(path) over (partition by conv_id order by d) as above from p),
node as (select d, path, min(conv_id) as conv_id, count(*) as n, any_value(above) as above, any_value(chars) as chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = size), '')) as ends_sha256 from s group by 1, 2),
kids as (select d - 1 as d, above as path, count(*) as n_children from node where d > 0 group by 1, 2),
leaf as (select node.* from node left join kids using (d, path) where n_children is null),
leaves as (select s.d, s.path, count(*) as n_leaves from leaf join s on s.conv_id = leaf.conv_id and s.d <= leaf.d group by 1, 2),
saved as (select s.d, s.path, sum((node.n - 1) * node.chars)::bigint as saved_tokens from node join s on s.conv_id = node.conv_id and s.d <= node.d group by 1, 2)
select node.conv_id, node.d::bigint as depth, up.conv_id as parent_conv_id, node.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, node.ends_sha256
from node join leaves using (d, path) join saved using (d, path) left join kids using (d, path) left join node up on up.d = node.d - 1 and up.path = node.above
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
