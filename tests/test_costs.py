"""Shortcuts of row-wise functions against their plain forms, and what is computed once."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from sparkloom.functions import secrets, text
from sparkloom.operators import rules

ODD = [None, "", " ", "  \x1c", "a" * 40, "a" * 39, "é" + "b/+=9" * 8 + "!", "x " + "Z" * 41, "AKIA" + "A" * 16, "akia" + "A" * 16, "sk-" + "a" * 20, "ghp_" + "b" * 36, "ghx_" + "b" * 36, "xoxb-" + "1" * 10, "AIza" + "c" * 35]
ODD += ["eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "-----BEGIN RSA PRIVATE KEY-----", "Password: hunter22", "1.2.3.4", "1.2.3", "\x00\x01\b\t\n\v\f\r\x1e\x1f\"\\", "line\nline\ttab", " 😀\x7f"]


def test_scan_and_json_strings_equal_their_plain_forms(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    t = F.col("t")
    plain = F.filter(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in secrets.SCAN.items())), lambda x: x.isNotNull())
    got = rows.select("k", secrets.found_secrets(t).alias("found"), plain.alias("plain"), text.json_string(t).alias("j")).collect()
    assert all(r.found == r.plain for r in got) and {x for r in got for x in r.found} == set(secrets.SCAN)
    assert all(r.j == (None if ODD[r.k] is None else json.dumps(ODD[r.k], ensure_ascii=False)) for r in got)


def test_structural_rules_are_computed_once(spark):
    message = lambda c: [("user", "hi"), ("assistant", c)]
    rows = spark.createDataFrame([(str(k), "plan" if k % 2 else "en", message(t), None) for k, t in enumerate(ODD)], "id string, category string, messages array<struct<role string, content string>>, tools string")
    found = rules.validate(rows, hash_col=None)
    plan = found.where("level = 'err'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AKIA[0-9A-Z]") == 2  # of contents and of tools; a filter on the size of all violations repeats them
    empty = {str(k) for k, t in enumerate(ODD) if not re.sub(r"[\s\x1c-\x1f]+", "", t or "")}
    got = found.collect()
    assert {r.id for r in got if r.code == "C2"} == empty
    assert {int(r.id) % 2 for r in got if r.code not in ("C1", "C2", "C3", "C5")} == {1}  # rules of plans


def test_redaction_counts_equal_the_plain_chain(spark):
    tails = ["1.2.3.4", "v1.2.3", "1.22.333.4 and 5.6.7.8", "256.1.1.1", "a@b.co", "a.b@c.d.ef_x@y.zz", "@", "x@y", "Token: " + "Q" * 20 + " é", "AUTH=" + "z" * 25 + " me@ex.org 10.0.0.1", "İ.pwd: hunter2222"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD + tails)], "k int, t string")
    t, n = F.col("t"), F.lit(0)
    for pattern, placeholder in secrets.REDACT:
        n, t = n + F.regexp_count(t, F.lit("(?i)" + pattern)), F.regexp_replace(t, "(?i)" + pattern, placeholder)
    got = rows.select("k", secrets.redaction_count(F.col("t")).alias("n"), n.alias("plain")).collect()
    assert all(r.n == r.plain for r in got) and sum(r.n or 0 for r in got) > 8
    plan = rows.select(secrets.redaction_count(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 + len(secrets.REDACT)  # once for the text and once for each replacement, not for each mark
