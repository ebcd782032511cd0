"""Revisions against a loop over changes, and writers at the same time."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from sparkloom.functions.text import content_hash
from sparkloom.operators import revisions, rules
from sparkloom.schema import MESSAGES

CHANGES = f"id string, n long, op string, category string, messages {MESSAGES}, tools string, source string, group_id string, status string"


def _loop(rows, changes):
    """The changes one by one on rows (id -> fields), and those that are refused."""
    rows, bad = {k: dict(v) for k, v in rows.items()}, []
    for c in sorted(changes, key=lambda c: c["n"]):
        there = rows.get(c["id"])
        if (c["op"] == "create") == (there is not None):
            bad.append((c["id"], c["n"]))
        elif c["op"] == "create":
            rows[c["id"]] = {k: c[k] for k in ("category", "messages", "tools", "source", "group_id")} | {"status": "draft"}
        elif c["op"] == "delete":
            del rows[c["id"]]
        elif c["op"] == "status":
            there["status"] = c["status"] or there["status"]
        else:
            there.update({k: c[k] for k in ("category", "source") if c[k]} | {k: c[k] for k in ("messages", "tools", "group_id") if c[k] is not None})
    return rows, bad


def _some(rng, count, low):
    out = []
    for n in rng.sample(range(low, low + 20_000), count):
        said = [("user", rng.choice("abc")), ("assistant", "x\n" + str(n))]
        one = {"id": f"e{rng.randrange(12)}", "n": n, "op": rng.choice(["create", "update", "update", "status", "delete"]), "category": rng.choice([None, "plan", "loop"]), "messages": rng.choice([None, said]),
               "tools": rng.choice([None, None, "[1]"]), "source": rng.choice([None, "s", "t"]), "group_id": rng.choice([None, "g"]), "status": rng.choice(["approved", "rejected"])}
        if one["op"] == "create":
            one |= {"category": one["category"] or "plan", "source": one["source"] or "m"}
        out.append(one)
    return out


def test_changes_like_a_loop(spark, tmp_path):
    rng, table, want = random.Random(4), revisions.Table(spark, f"file://{tmp_path}", buckets=2), {}
    assert table.version() == 0 and table.rows().count() == 0
    for k in range(3):
        some = _some(rng, 90, k * 30_000)
        df = spark.createDataFrame([tuple(c.values()) for c in some], CHANGES)
        lost = {(r.id, r.n) for r in revisions.refused(table.rows(), df).collect()}
        want, bad = _loop(want, some)
        assert lost == set(bad) and bad
        assert table.apply(df) == k + 1
        got = {r.id: r.asDict(True) for r in table.rows().withColumn("again", content_hash(F.col("messages"), F.col("tools"))).collect()}
        assert set(got) == set(want)
        for key, row in want.items():
            plain = [tuple(m.values()) for m in got[key]["messages"]] if got[key]["messages"] is not None else None
            tools = rules.registry_tools() if row["tools"] is None and row["category"] == "loop" else row["tools"]
            assert (plain, got[key]["tools"]) == (row["messages"], tools) and got[key]["again"] == got[key]["content_hash"]
            assert [got[key][c] for c in ("category", "source", "group_id", "status")] == [row[c] for c in ("category", "source", "group_id", "status")]
    before = {r.id: r.content_hash for r in table.rows(2).collect()}
    assert table.compact() == 4 and {r.id for r in table.rows().collect()} == set(want) and table.revisions().count() == len(want)
    assert {r.id: r.content_hash for r in table.rows(2).collect()} == before  # earlier versions stay
    assert {r.id for r in table.row("e3").collect()} == {"e3"} & set(want)


def test_no_change_without_effect(spark):
    none = spark.createDataFrame([], revisions.ROW)
    odd = spark.createDataFrame([(None, 1, "create", *[None] * 6), ("a", None, "create", *[None] * 6), ("b", 1, "merge", *[None] * 6), ("c", 1, "update", *[None] * 6), ("d", 1, "create", *[None] * 6), ("d", 2, "delete", *[None] * 6)], CHANGES)
    assert revisions.revised(none, odd, F.current_timestamp()).count() == 0
    assert {(r.id, r.reason) for r in revisions.refused(none, odd).collect()} == {("c", "missing")}


def test_writers_at_the_same_time(spark, tmp_path):
    path = f"file://{tmp_path}"
    say = lambda n, text: [("user", "q"), ("assistant", text)]

    def write(k):
        table = revisions.Table(spark, path, buckets=2)
        rows = [(f"w{k}", 1, "create", "plan", say(k, f"own {k}"), None, "m", None, None), ("all", 1, "create", "plan", say(k, f"first {k}"), None, "m", None, None)]
        return table.apply(spark.createDataFrame(rows, CHANGES), tries=20)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    table = revisions.Table(spark, path)
    got = {r.id: r.messages[1].content for r in table.rows().collect()}
    first = versions.index(1)
    assert got == {f"w{k}": f"own {k}" for k in range(4)} | {"all": f"first {first}"}  # the others found a row and were refused
    assert len(list(tmp_path.glob("data/*"))) == 4 and not list(tmp_path.glob("versions/.*[!c]"))  # nothing is left of lost races


def test_violations_of_revised_rows(spark):
    plan = "some longer answer about the plan of the next release and its parts, number "
    rows = [(f"p{k}", k, "create", "plan", [("user", "q"), ("assistant", plan + text)], None, "m", None, None) for k, text in enumerate(["one", "one, more or less", "ONE"])]
    none = spark.createDataFrame([], revisions.ROW)
    table = revisions.revised(none, spark.createDataFrame(rows, CHANGES), F.current_timestamp()).drop("deleted")
    new = [("n1", 1, "create", "plan", [("user", "q"), ("assistant", plan + "one")], None, "m", None, None), ("n2", 1, "create", "plan", [("user", "q"), ("assistant", plan + "onex")], None, "m", None, None), ("p1", 9, "delete", *[None] * 6)]
    fresh = revisions.revised(table, spark.createDataFrame(new, CHANGES), F.current_timestamp())
    found = {(r.id, r.level, r.location) for r in revisions.violations(table, fresh).where("code = 'C6'").collect()}
    assert found == {("n1", "err", None), ("n1", "warn", "p2"), ("n1", "warn", "n2"), ("n2", "warn", "n1"), ("n2", "warn", "p0")}
