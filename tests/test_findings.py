"""What a review found on larger tables: bounded keys, whole sessions, plain passes over text."""

from __future__ import annotations

import numpy as np

from sparkloom.operators import similarity


def test_large_sets_have_a_fixed_number_of_keys():
    rng = np.random.default_rng(5)
    for size in (300, 3000, 30_000):
        u = rng.integers(-(2**63), 2**63 - 1, size + size // 8, dtype=np.int64)
        extra = size // 13
        a, b = np.sort(u[:size]), np.sort(u[extra : size + extra])  # similarity 0.857
        x, y = ({c: (need, set(k.tolist())) for c, need, k in similarity.pigeonhole_keys(s, 0.85)} for s in (a, b))
        assert sum(len(k) for _, k in (*x.values(), *y.values())) <= 4 * similarity.bands(0.85)[1]
        assert any(len(x[c][1] & y[c][1]) >= max(x[c][0], y[c][0]) for c in x.keys() & y.keys())
        assert not any(x[c][1] & set(k.tolist()) for c, _, k in similarity.pigeonhole_keys(np.sort(~u), 0.85) if c in x)
    rows, n = similarity.bands(0.85)
    p = 0.85**rows
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= 1e-12


def test_pairs_in_steps_move_texts_once(spark):
    rows = spark.createDataFrame([(k, f"a text of some words, number {k}") for k in range(6)], "doc_id long, text string")
    keys, pairs = spark.createDataFrame([], "id string, n int, class int, need int, key long"), spark.createDataFrame([], "first_id string, second_id string")
    found = similarity.near_texts_next(rows, keys, pairs)[1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("keyed(") <= 2 and plan.count("Join") < 12  # keys are made for the two sides of one join; 3 and 25 before


def _events(spark, session, kinds):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, session, event, data) for k, (event, data) in enumerate(kinds)], "id long, session_id string, event string, data string")
    return rows.withColumns({"model_version": F.lit("m"), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))})


def test_sessions_are_searched_whole(spark):
    from sparkloom.operators import sessions
    from sparkloom.streaming import cases

    log = _events(spark, "s", [("message", "{}")] * 520 + [("cancel", "{}"), ("verdict", '{"verdict": "PASS"}'), ("outcome", '{"success": false}')])
    signals = lambda d: sorted(r.signal for r in d.collect())
    assert signals(sessions.detect_cases(log)) == ["cancelled", "pass_then_failed"]
    assert signals(sessions.detect_cases(log, rate=1.0, limit=500)) == ["clean"]
    assert signals(cases.replayed(log, batches=2, quiet="30 minutes")) == ["cancelled", "pass_then_failed"]


def test_next_values_come_from_frames_that_only_grow(spark):
    from sparkloom.operators import sessions

    call = '{"role": "assistant", "name": "a", "arguments": {}}'
    log = _events(spark, "s", [("tool_call", call), ("tool_result", '{"error": "x"}'), ("message", '{"role": "user"}'), ("message", call), ("tool_result", '{"error": "x"}'), ("message", '{"role": "assistant"}')])
    found = sessions.unchanged_after_error(log)
    assert [r.id for r in found.collect()] == [1]
    for plan in (found, sessions.detect_cases(log)):  # a frame that ends at the last row, but starts at the current one, takes the square of a session's length
        assert "1, unboundedfollowing" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_redaction_steps_are_computed_once(spark):
    import re

    from pyspark.sql import functions as F

    from sparkloom.functions import secrets

    rows = spark.createDataFrame([("password: hunter2hunter2 at 10.0.0.1, 10.0.0.2 and a@b.org",), ("SECRET=abcdefghijklmnopqrstuvwx",), ("nothing",), (None,)], "t string")
    out = rows.select(secrets.redaction_count(F.col("t")).alias("n"), secrets.redaction_audit(F.col("t")).alias("a"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 2 * len(secrets.REDACT)  # a hundred each before
    got = out.collect()
    assert [r.n for r in got] == [4, 1, 0, None] and [len(r.a) if r.a is not None else 0 for r in got] == [3, 1, 0, 0]
    for (pattern, _), marks in zip(secrets.REDACT, secrets.MARKS, strict=True):
        plain = re.sub(r"\\([.\-])", r"\1", pattern).lower()
        assert any(m in plain for m in marks) or marks in (("ghp_", "gho_", "github_pat_"), ("passw", "pwd"))


def test_tokens_are_counted_in_bounded_batches(monkeypatch):
    from sparkloom.functions import tokens

    seen = []

    class Fake:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(sum(map(len, texts)))
            return [t.split() for t in texts]

    monkeypatch.setattr(tokens, "_tokenizer", lambda path: Fake())
    texts = ["a b " * 1000, None, "", "c"] * 300 + ["d " * tokens.BATCH_CHARS]
    assert list(tokens._lengths(texts, "x")) == [len((t or "").split()) for t in texts]
    assert len(seen) > 4 and max(seen[:-1]) <= tokens.BATCH_CHARS
    assert list(tokens._lengths([], "x")) == []


def _copies(n=30):
    words = [f"word{k * k % 97}" for k in range(60)]
    return [" ".join([*words[:k], f"other{k}", *words[k + 1 :]]) for k in range(n)]


def _similar(texts, threshold=0.85):
    from sparkloom.functions.text import grams_of

    sets = [grams_of(t) for t in texts]
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    return {(a, b, n, len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n)}


def test_many_similar_texts_are_a_crowd_and_no_pairs(spark, monkeypatch):
    texts = [*_copies(), "a small text", "a small text!", _copies()[0].upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _similar(texts[:-1])
    monkeypatch.setattr(similarity, "BLOCK", 8)
    found, kept = similarity._candidates, []
    monkeypatch.setattr(similarity, "_candidates", lambda *a: kept.append(found(*a)) or kept[0])
    assert {tuple(r) for r in similarity.near_duplicates(rows).collect()} == want and len(want) > 300
    pairs, crowds = kept[0]
    assert crowds.count() >= 30 and pairs.count() <= 1  # a row for each pair before, which took its text along


def test_texts_of_the_same_32_bits_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [*_copies(5), "quite another text, which is like no other"]
    monkeypatch.setattr(similarity, "_who", lambda: F.lit(7))
    found = similarity.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == _similar(texts)


def test_crowds_in_steps(spark):
    texts = _copies(20)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = {r.id: texts.index(r.text) for r in similarity.text_ids(rows).collect()}
    named = lambda d: sorted(tuple(sorted((said[r.first_id], said[r.second_id]))) for r in d.collect())
    want = sorted((a, b) for a, b, *_ in _similar(texts))
    keys, pairs = similarity.near_texts_next(rows.where("doc_id % 2 = 0"), spark.createDataFrame([], similarity.KEYS), spark.createDataFrame([], similarity.PAIRS))
    assert named(similarity.near_texts_next(rows, keys, pairs)[1]) == want
    old = spark.createDataFrame([(next(iter(said)), 1, 2, 3, 4)], "id string, n int, class int, need int, key long")  # what an earlier version stored
    assert named(similarity.near_texts_next(rows, old, pairs)[1]) == want
