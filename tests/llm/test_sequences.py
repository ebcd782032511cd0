"""op11, op12 and op13 against brute force: small alphabets, so that prefixes, windows and numbers collide often."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import change_feed, prefix_trie, substring
from sparkloom.llm.ordered import positions

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
CLASHES = ("id", "node", "depth", "k", "n", "h", "size", "tail", "low", "digest", "row_key", "first", "start", "batch", "day", "held", "file", "place", "_part", "before")


def wide(df):
    """df with columns of names that operators use inside."""
    return df.select(*(F.lit("x").alias(c) for c in CLASHES if c not in df.columns), *df.columns)


# --- op11


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].add(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    out = set()

    def visit(path):
        leaves, saved = 0 if kids[path] else 1, (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        for x in kids[path]:
            a, b = visit(x)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        out.add((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if built:
        visit(())
    return out


def trie(df):
    return [tuple(r) for r in prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.turns(df))).collect()]


def test_trie_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 60), *range(100, 140), 207, 311, 312]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None]) if t else "a"))
    rows += [(c, t, "user", "same") for c in range(400, 430) for t in range(15)]  # copies to the end
    rows += [(None, 0, "user", "no conversation"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame(rows, TURNS)
    got = trie(df)
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(rows)
    assert sorted(trie(wide(df)), key=str) == sorted(got, key=str)


def test_trie_of_conversations_as_they_are(spark):
    long = "x" * 3_000_000
    df = spark.createDataFrame([(1, 0, "user", long), (2, 0, "user", long), (2, 1, "user", "y")], TURNS)
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.saved_tokens) for r in prefix_trie.build(*prefix_trie.plain(prefix_trie.turns(df))).collect()}
    assert got == {(1, 0): (2, 1, 3_000_000), (1, 1): (2, 1, 3_000_000), (2, 2): (1, 0, 0)}
    assert trie(spark.createDataFrame([], TURNS)) == []


def test_positions_inside_a_key_that_holds_most_rows(spark):
    rows = [(None if k % 5 else k % 7, k * 7919 % 1000, k % 3) for k in range(1000)]
    got = positions(spark.createDataFrame(rows, "key long, o long, v long"), ["key"], ["o"], total="v").collect()
    groups = defaultdict(list)
    for key, o, v in rows:
        groups[key].append((o, v))
    want = {(key, o): (k + 1, sum(x for _, x in sorted(g)[:k])) for key, g in groups.items() for k, (o, _) in enumerate(sorted(g))}
    assert {(r.key, r.o): (r.k, r.before) for r in got} == want


# --- op12


def removal_by_hand(rows, size):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k : k + size])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 512])
def test_removed_words_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "LONGEST", 16)
    rng = random.Random(11)
    passages = [[rng.choice("a b c dé 漢 E e".split()) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = [(None, "a b c d e f g h i j k l m"), (None, "a b c d e f g h i j k l m"), (3, None), (4, ""), (5, " \t\n "), (6, "a " * 200), (7, "a " * 100), (8, "a b " * 50)]
    for k in range(9, 90):
        words = [w for _ in range(rng.randint(1, 3)) for w in (rng.choice(passages) + [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(0, 9))])]
        rows.append((rng.choice([k, k, k - 3]), rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [rows[-1], rows[-1], (200, rows[-1][1])]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in substring.deduplicated(df, size=12, gram=4).collect()), key=str)
    assert got == removal_by_hand(rows, 12) and sum(r[2] for r in got) > 500
    assert got == sorted((tuple(r) for r in substring.deduplicated(wide(df), size=12, gram=4).collect()), key=str)


def test_removal_from_very_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(400_000))
    rows = [(1, long), (2, "own words " + long), (3, "x")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (400_000, 0), 2: (400_002, 400_000), 3: (1, 0)}
    assert substring.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


def test_ranked_windows_are_exact():
    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(rng.randint(7, 30))] for _ in range(40)]
    owner, begin, end = substring.earlier_windows([" ".join(t).encode() for t in texts], np.arange(40)[::-1] // 2, 7)
    first = [(39 - k) // 2 for k in range(40)]
    least = {}
    for k, t in enumerate(texts):
        for a in range(len(t) - 6):
            g = tuple(t[a : a + 7])
            least[g] = min(least.get(g, 99), first[k])
    want = {(k, a) for k, t in enumerate(texts) for a in range(len(t) - 6) if least[tuple(t[a : a + 7])] < first[k]}
    assert {(k, a) for k, x, y in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True) for a in range(x, y)} == want


# --- op13


def applied_by_hand(rows):
    seqs = defaultdict(set)
    for r in set(rows):
        seqs[r[1]].add(r[2])
    rank = {c: {s: k + 1 for k, s in enumerate(sorted(x, key=lambda v: (v is not None, v or 0)))} for c, x in seqs.items()}
    batches, clients, out, largest = defaultdict(list), {}, {}, None
    for r in set(rows):
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0
        if r[4] is not None and h % 11:
            day = (r[4].date() - datetime.date(1970, 1, 1)).days + 2 * (h % 4)
            batches[max(1, min(8, 1 + math.floor((day - 19723) * 8 / 160)))].append((day, r[0], r[1], rank[r[1]][r[2]], r[3], r[7], r[8]))

    def drain(c, batch, missed):
        s = clients[c]
        while s["next"] in s["held"]:
            _, change, op, city, balance = s["held"].pop(s["next"])
            if op == "I":
                s["now"] = (city, balance)
            elif op == "U":
                s["now"] = (city if city is not None else s["now"][0], balance if balance is not None else s["now"][1])
            elif op == "D":
                s["now"] = (None, None)
            money = s["now"][1]
            out[change] = [c, "applied", batch, missed, s["now"][0], None if money is None or not math.isfinite(money) else math.floor(100 * money + 0.5), False]
            s["last"], missed, s["next"] = (change, op), 0, s["next"] + 1

    def jump(batch, clock):
        for c, s in clients.items():
            while s["held"] and (clock is None or min(x[0] for x in s["held"].values()) + 5 <= clock):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                drain(c, batch, missed)

    for batch in range(1, 9):
        if largest is not None:
            jump(batch, largest)
        for day, change, c, n, *rest in sorted(batches[batch], key=lambda x: x[:2]):
            s = clients.setdefault(c, {"next": 1, "held": {}, "now": (None, None), "last": None})
            if n in s["held"] or n < s["next"]:
                out[change] = [c, "rejected", batch, 0, None, None, False]
            else:
                s["held"][n] = (day, change, *rest)
                drain(c, batch, 0)
        largest = max([largest or 0, *(x[0] for x in batches[batch])]) if batches[batch] else largest
    jump(9, None)
    for s in clients.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][6] = True
    return sorted(((k, *v) for k, v in out.items()), key=str)


def test_changes_equal_brute_force(spark):
    """Pages of 4 numbers, of which few are held in memory, one client with most rows, two batches without rows, and rows of every odd kind."""
    rng = random.Random(17)
    rows = []
    for k in range(700):
        day = rng.choice([rng.randint(0, 50), rng.randint(90, 125)])
        seq = None if k % 90 == 0 else int(day * 2 + rng.randint(-8, 8))
        client = rng.choice([7, 7, None, *range(12)])
        at = None if k % 50 == 3 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=k % 24)
        rows.append((k if k != 5 else None, client, seq, rng.choice(["I", "U", "U", "U", "D", None, "X"]), at, "s", None, rng.choice(["A", "B", None]), rng.choice([None, 1.005, -2.5, 1e300, 12.345, float("inf")])))
    rows += [(1000 + k, 99, k, "U", datetime.datetime(2024, 5, 25), "s", None, "A", float(k)) for k in range(60)]  # some wait to the end
    rows += rows[:40]
    df = spark.createDataFrame(rows, CHANGES)
    got = sorted((tuple(r) for r in change_feed.apply_changes(wide(df), page=4, cached=6).collect()), key=str)
    want = sorted(((*r[:6], None if r[6] is not None and abs(r[6]) >= 9e18 else r[6], r[7]) for r in applied_by_hand(rows)), key=str)
    assert got == want
    assert {r[2] for r in got} == {"applied", "rejected"} and 9 in {r[3] for r in got} and any(r[4] > 0 for r in got)
    assert change_feed.apply_changes(spark.createDataFrame([], CHANGES)).collect() == []
