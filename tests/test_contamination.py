"""Contamination and containment against all pairs, by broadcast postings and by rare grams."""

from __future__ import annotations

import random
import re

import pytest

from sparkloom.operators import similarity


def grams(t):
    t = re.sub(r"\s+", " ", (t or "").lower()).strip()
    return {t[k : k + 5] for k in range(len(t) - 4)} if len(t) > 5 else ({t} if t else set())


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_pairs_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "BROADCAST_GRAMS", limit)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 6)))
    items = [(f"i{k}", " ".join(["common start of all items", *(word() for _ in range(rng.randint(1, 12)))])) for k in range(25)] + [("empty", ""), ("null", None), ("short", "ab"), ("same", None)]
    docs = [(k, rng.choice(items)[1]) for k in range(20)]
    docs = [(k, t and (t + " " + word()) * rng.randint(1, 2) + "x" * rng.choice((0, 0, 30))) for k, t in docs] + [(100, "AB"), (101, None), (102, "  "), (None, items[0][1]), (103, "common start of all items " * 50)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.common, r.n_union) for r in similarity.contamination(d, e, 0.3).collect()}
    held = {(r.doc_id, r.item_id, r.common, r.n_eval) for r in similarity.containment(d, e, 0.9).collect()}
    sets = [(k, i, grams(t), grams(u)) for k, t in docs for i, u in items]
    key = lambda k: limit or k is not None  # noqa: E731  a join by id has no pairs of a null one
    assert {x for x in got if key(x[0])} == {(k, i, len(g & h), len(g | h)) for k, i, g, h in sets if key(k) and g & h and len(g & h) >= 0.3 * len(g | h)} and len(got) > 20
    assert {x for x in held if key(x[0])} == {(k, i, len(g & h), len(h)) for k, i, g, h in sets if key(k) and h and g & h and len(g & h) >= 0.9 * len(h)} and held
    none = spark.createDataFrame([], e.schema)
    assert similarity.contamination(d, none).count() == similarity.contamination(spark.createDataFrame([], d.schema), e).count() == 0


def test_items_that_share_grams_with_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(similarity, "PLACES", 100)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    items, docs = [text(40) for _ in range(90)] + ["", "zz"], [text(3000), "zz", "", "q" * 50]
    many, whole = [], similarity.np.arange
    monkeypatch.setattr(similarity.np, "arange", lambda *a: many.append(a[0]) or whole(*a))
    of = similarity._Items([similarity.grams_of(t) for t in items])
    for d in docs:
        del many[:]
        g = similarity.grams_of(d)
        assert of.common(g).tolist() == [len(set(g) & set(similarity.grams_of(t))) for t in items]
        assert max(many, default=0) < 100 + len(items)
