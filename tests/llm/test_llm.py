"""Operators of the subpackage llm against brute force, round trips and held-out accuracy, with the edge cases of their docstrings."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import json
import math
import random
import re
import time
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, html_text, license_scan, minhash, preference, segment, token_output, toxicity, url_filter, vectors
from sparkloom.llm import words as W

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(900, None), (901, ""), (902, "..."), (None, "a null id"), (903, "x" * 5000 + " é漢字😀 <b>&amp;"), (904, "tie"), (904, "tie")]


def words(t):
    return WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))


def docs_frame(spark, rows):
    """With extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "a", 1, 0) for i, t in rows], "doc_id long, text string, node string, n int, id int")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta2"]) + rng.choice(["", "s", "x"]) for _ in range(n))


def test_words_split():
    texts = ["", "A b-C ÉÉ 漢字!x", None, "zz", "...", "q"]
    got = W.split(pa.array(texts))
    assert got.count.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(got.hash.tolist())) == len(set(flat))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, k) for k in range(400, 440)]
    group = {k: k for e in links for k in e}
    for _ in group:
        for u, v in links:
            group[u] = group[v] = min(group[u], group[v])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: r for k, r in group.items() if any(k in e and e[0] != e[1] for e in links)}


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        base = prose(rng, rng.choice([2, 6, 40, 120])).split()
        for j in range(4):
            copy = list(base)
            for _ in range(j * len(copy) // 45):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(copy)))
    return rows + [(200, "same same same same same same same"), (201, "same same same same same same same same")] + ODD


def near_classes(rows):
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else None for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = bags[a], bags[b]
        same = x is not None and y is not None and sum((x & y).values()) >= 0.8 * sum((x | y).values())
        if same or (x is None and y is None and rows[a][1] is not None and rows[a][1] == rows[b][1]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if r == hi else r for r in root]
    return [min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root]


def test_minhash_against_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(docs_frame(spark, rows)).collect()
    want = collections.Counter((i, c) for (i, _), c in zip(rows, near_classes(rows), strict=True))
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want
    groups = collections.Counter(r.component_id for r in got if r.kept)
    assert all(n == 1 for c, n in groups.items() if c is not None) and set(groups) == {r.component_id for r in got}
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_signatures_are_unbiased():
    a = {k: 1 + k % 7 for k in range(200)}
    b = {k: 1 + (k + (k % 3 == 0)) % 7 for k in range(40, 240)}
    sig = []
    for x in (a, b):
        v = W.mix(np.array(sorted(x), np.uint64))
        sig.append(minhash.signatures(np.zeros(len(x), np.int64), v, np.array([x[k] for k in sorted(x)]), 1, 8192)[0])
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(240)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(240))
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 8192)


def test_across_blocks_finds_what_stars_miss():
    base = [f"w{k}" for k in range(200)]
    rows = []
    for name, lo, hi in (("a", 0, 0), ("b", 0, 12), ("c", 12, 24)):
        t = " ".join(w if not lo <= k < hi else w + name for k, w in enumerate(base))
        split = W.split(pa.array([t]))
        d, v, c = W.bag(split)
        keys = minhash.band_keys(minhash.signatures(d, v, c, 1, 160), 32, 5)[0].tolist()
        rows.append({"node": minhash.node_keys(split)[0], "n": int(c.sum()), "root": minhash.node_keys(split)[0], "keys": keys, "text": t})
    assert len(minhash._across(rows, rows[1:], 5, 0.8)) == 2


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + 0.12 * rng.normal(size=(30, 16)), x[:10], x[:5] * 3, x[:4] + 0.2]).astype(np.float32)
    rows = [(k, [float(a) for a in v], int(k % 30) % 2) for k, v in enumerate(x)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16).collect()}
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all() and any(v) and y is not None]
    n, root = collections.Counter(), {i: i for i, _, _ in rows}
    for (i, v, y), (j, w, z) in itertools.combinations(ok, 2):
        if y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
            n[i] += 1
            n[j] += 1
            lo, hi = sorted((root[i], root[j]))
            root = {k: lo if r == hi else r for k, r in root.items()}
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {i: (n[i], root[i], root[i] == i) for i, _, _ in rows} and sum(n.values()) > 40


def windows_of(items):
    out = {}
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if w else ():
            out.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", 300)
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 25]))) for k in range(12)] + [(50, ""), (51, None), (52, "one")]
    rows = [(k, prose(rng, 30) + " " + (rng.choice(items)[1] or "") + " " + prose(rng, rng.randrange(60))) for k in range(60)] + ODD + [(700, "One, one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs_frame(spark, rows), bench).collect()
    found = windows_of(items)
    want = collections.Counter()
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in found:
                    hit |= set(range(k, k + size))
                    names |= found[tuple(w[k : k + size])]
        want[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    text = dict(rows)
    for r in got:
        assert sum(len(words(text[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    nameless = decontaminate.scan(docs_frame(spark, [(1, "x " + items[3][1])]), spark.createDataFrame([(None, items[3][1])], "item_id long, text string")).first()
    assert (nameless.n_items, nameless.items_sha256, nameless.contaminated) == (1, hashlib.sha256(b"").hexdigest(), True)
    assert decontaminate.scan(docs_frame(spark, []), bench).count() == 0
    assert decontaminate.scan(docs_frame(spark, rows), bench.where("false")).where("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.scan(docs_frame(spark, rows), bench, max_benchmark_bytes=5)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    sym = np.append(rng.integers(0, 5, 400), 0)
    index = decontaminate.FMIndex(sym, 5)
    for size in (1, 2, 4):
        pattern = rng.integers(1, 5, (20, size))
        sp, ep = index.search(pattern, np.full(20, size))
        for p, a, b in zip(pattern, sp, ep, strict=True):
            want = [k for k in range(len(sym) - size + 1) if (sym[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_url_rules(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "a.b/"), ("allow", "x.a.b/p/q")]
    urls = ["http://example.com/en/71", "https://WWW.Example.com/en/8?q#f", "http://com/en/", "http://notcom/en/", "http://x.a.b/p/qq", "http://x.a.b", "http://y.a.b/", "a.b/", None, "", "ftp://a.b?x/", "://a.b/z"]
    index = url_filter.build(spark, iter(rules))
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), index).orderBy("page_id").collect()]
    for k, host, path, rule, verdict in got:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[k] or "", re.S)
        assert (host, path) == ((m[1].lower(), m[2]) if m else ("", ""))
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (rule, verdict) == (max(fit)[1:] if fit else (None, "allow"))
    empty = url_filter.build(spark, iter([]))
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame([(1, urls[0])], "page_id int, url string"), empty).collect()} == {"allow"}


def test_digest_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda keys: np.array([len(k) % 2 for k in keys], np.uint64))
    index = url_filter.Index(url_filter.build(spark, iter([("block", "a/x"), ("block", "b/y"), ("allow", "cc/")])))
    assert index.find(["b/y", "a/y", "cc/", "a/x"]).tolist().count(-1) == 1


@pytest.mark.parametrize("rules", [[("block", "a/x"), ("allow", "cc/")], []])
def test_digest_files_of_another_store_are_copied_once(spark, tmp_path, monkeypatch, rules):
    url_filter.build(spark, iter(rules), str(tmp_path / "rules"))
    fs = pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem())
    store = types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=lambda _: (fs, "rules")), LocalFileSystem=pa.fs.LocalFileSystem, copy_files=pa.fs.copy_files)
    monkeypatch.setattr(url_filter, "pafs", store)
    index = url_filter.Index("other://rules")
    assert index.find(["cc/", "a/y", "a/x"]).tolist().count(-1) == (1 if rules else 3)
    folder = url_filter.copied(fs, "rules")
    assert folder.startswith(url_filter.SparkFiles.getRootDirectory()) and index.keys.filename == f"{folder}/keys.npy"


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(1, 60)) + (rng.choice([" you idiot", " total Scоm here", " vile1x thing", " v1lemost"]) if k % 4 == 0 else " villa" if k % 9 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    lexicon = toxicity.learn([(t, y) for k, t, y in rows if k % 3])
    a = lexicon.automaton()
    out = toxicity.score(docs_frame(spark, [(k, t) for k, t, _ in rows if k % 3 == 0] + ODD), lexicon).collect()
    label = {k: y for k, _, y in rows}
    assert np.mean([r.predicted == label.get(r.doc_id, 0) for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.evidence(a, "1d10t") > 0 and toxicity.evidence(a, "ＩＤＩＯＴ!") > 0 and toxicity.evidence(a, "2024 idiotic-free") == 0
    exempt = toxicity.Lexicon(stems={"vile": 5.0}, exceptions={"vilenius"}).automaton()
    assert toxicity.evidence(exempt, "vilenius") == 0 < toxicity.evidence(exempt, "vilest")
    assert toxicity.evidence(toxicity.learn([]).automaton(), "x") == 0


def test_toxicity_fit_takes_an_id_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "learn", sorted)
    docs = docs_frame(spark, [(1, "b"), (1, "a"), (1, None), (2, "c"), (3, None), (None, "d")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (3, 1), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, train="true") == [("a", 1), ("c", 0)]
    assert len(toxicity.fit(docs, labels, train="true", max_chars=1)) == 1


def test_toxicity_fit_reads_only_the_rows_asked_for(spark):
    docs = docs_frame(spark, [(k, f"bad word{k}" if k % 2 else f"good word{k}") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2 if k < 30 else 1 - k % 2) for k in range(40)], "doc_id long, toxic int")
    assert "bad" in toxicity.fit(docs, labels, train="doc_id < 30").words


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("public_tokenizers")


def test_token_files(spark, tokenizers, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randrange(40))) for k in range(80)] + ODD + [(-5, "it's 3.5 a.'s b,'t ''  \x85 \x1c x\x01y <|endoftext|> z"), (-6, "Café ſ ß İ ½ 2.́"), (-7, "a \x01 b")]
    folder = "file://" + str(tmp_path / "out")
    shards = token_output.write(docs_frame(spark, rows), folder, path, partitions=3)
    got = token_output.read(shards, folder, with_ids=True).orderBy("start").collect()
    plain = Tokenizer.from_file(path)
    want = sorted(((i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.doc_id, r.ids) for r in got] == want
    assert [r.start for r in got] == [0, *itertools.accumulate(len(x) for _, x in want)][:-1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    assert token_output.round_trip(docs_frame(spark, []), path).count() == 0
    assert token_output.unpack(token_output.pack(b"\x01\x00", True, 70_000)[1]).tolist() == [1, 70_000]


def test_token_files_split_hot_ids(spark, tokenizers, tmp_path):
    path, rng = tokenizers.path("word_bpe_49k.json"), random.Random(8)
    rows = [(rng.choice([None, None, 5, k]), prose(rng, rng.randrange(9))) for k in range(400)]
    folder = "file://" + str(tmp_path / "out")
    shards = token_output.write(docs_frame(spark, rows), folder, path, partitions=8)
    found = shards.collect()
    assert sum(r.low is None and r.high is None for r in found) >= 2 and sum(r.docs for r in found) == 400
    got = token_output.read(shards, folder, with_ids=True).orderBy("start").collect()
    keys = [(r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got]
    assert keys == sorted(keys)
    encode = token_output.encoder(path).tokenizer.encode
    want = collections.Counter((i, *encode(t, add_special_tokens=False).ids, 1) for i, t in rows)
    assert collections.Counter((r.doc_id, *r.ids) for r in got) == want
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def test_token_dictionary_at_every_size(spark, tokenizers):
    path, rng = tokenizers.path("word_bpe_49k.json"), random.Random(9)
    for rows, magic in (([], False), ([(1, None)], False), ([(1, "a b")], False), ([(k, prose(rng, 300)) for k in range(60)], True), ([(1, prose(rng, 20_000))], False), ([(k, "the same words again " * 150) for k in range(60)], True)):
        data = token_output.train(docs_frame(spark, rows), path, 1, "doc_id", "text")
        assert bool(data) == bool(rows) and data.startswith(b"\x37\xa4\x30\xec") == magic


def test_token_ids_of_a_tokenizer_that_keeps_white_space(tokenizers):
    from tokenizers import Tokenizer

    assert token_output.cuttable(tokenizers.path("word_bpe_49k.json"))
    path = tokenizers.path("byte_bpe_50k.json")
    plain, texts = Tokenizer.from_file(path), ["  two  blanks\n\nlines ", "", "it's 3.5", "é漢字😀"]
    enc = token_output.Encoder(path)
    assert not enc.cuttable
    assert [np.frombuffer(x, "<u2" if enc.small else "<u4").tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def all_segmentations(v, t):
    t, out = v.normalize(t), []
    pieces = {p: i for i, p in enumerate(v.pieces) if v.logp[i] != 0}

    def walk(at, lp, ids):
        if at == len(t):
            out.append((tuple(ids), lp))
            return
        for e in range(at + 1, len(t) + 1):
            if t[at:e] in pieces:
                walk(e, lp + v.logp[pieces[t[at:e]]], [*ids, pieces[t[at:e]]])
        if t[at] not in pieces:
            raw = t[at].encode()
            walk(at + 1, lp + v.byte_logp * len(raw), [*ids, *(int(v.bytes[b]) for b in raw)])

    walk(0, 0.0, [])
    z = np.logaddexp.reduce([lp for _, lp in out])
    return {ids: lp - z for ids, lp in out}


def test_sampled_segmentations(tokenizers):
    v = segment.vocabulary(tokenizers.path("piece_bpe_32k.model"))
    want, n = all_segmentations(v, "the cat"), 6000
    found = collections.defaultdict(dict)
    for row in segment._samples(v, ["the cat"] * n, W.mix(np.arange(n, dtype=np.uint64)), 3, True):
        found[row[0]][row[1]] = row
    first, total = collections.Counter(), 0.0
    for m in found.values():
        ids = [tuple(m[k][8].tolist()) for k in range(3)]
        assert len(set(ids)) == 3 and m[0][5] > m[1][5] > m[2][5] and all(m[k][7] for k in range(3))
        assert all(abs(want[ids[k]] - m[k][4]) < 1e-4 for k in range(3))
        first[ids[0]] += 1
        total += sum(math.exp(m[k][4] - m[k][6]) for k in range(3))
    assert all(abs(first[s] / n - math.exp(p)) < 5 * math.sqrt(math.exp(p) / n) + 1e-3 for s, p in want.items())
    assert abs(total / n - 1) < 0.03  # inclusion scores make the sum of p / q unbiased


def test_no_segmentation_is_lost(tokenizers):
    """With a large k every segmentation of a text comes out once, with its probability, however improbable it is."""
    v = segment.vocabulary(tokenizers.path("piece_bpe_32k.model"))
    texts = ["the", "The", "and", "is", "a", "of", "ther", "tion", "nation", "Sterpf", "é漢字😀x", "xxxxxx", "the is", "12 ab"]
    found = collections.defaultdict(list)
    for row in segment._samples(v, texts, W.mix(np.arange(len(texts), dtype=np.uint64)), 400, True):
        found[row[0]].append(row)
    for k, t in enumerate(texts):
        want, rows = all_segmentations(v, t), found[k]
        assert {tuple(r[8].tolist()) for r in rows} == set(want) and len(rows) == len(want) < 400, t
        assert all(abs(want[tuple(r[8].tolist())] - r[4]) < 1e-6 and r[6] == 0 and r[7] for r in rows)
        assert all(a[5] > b[5] for a, b in itertools.pairwise(rows))


def test_what_is_left_of_a_word_keeps_its_precision():
    """A likely segmentation may leave 1e-20: the rest is summed, never a difference."""
    lattice = types.SimpleNamespace(first=np.array([0, 2, 4]), logc=np.array([-1e-20, math.log(1e-20), math.log(0.25), math.log(0.75)]), size=np.array([1, 2, 1, 1]))
    assert math.isclose(segment.Rest(lattice, 0, [[0, 2], [0, 3]]).left[0], 1e-20)
    assert math.isclose(segment.Rest(lattice, 0, [[0, 3], [1]]).left[0], 0.25)
    assert segment.Rest(lattice, 0, [[0, 3], [1], [0, 2]]).left[0] == 0
    assert segment.Rest(lattice, 0, [[0, 2], [0, 3]]).draw(iter([0.5])) == [1]
    assert segment.Rest(lattice, 0, [[0, 3], [1]]).draw(iter([0.5, 0.5])) == [0, 2]


def test_segmentation_edges(spark, tokenizers):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    rows = ODD + [(1, "x\n\ty  zé漢字😀"), (2, "a"), (3, "word " * 300)]
    got = segment.sample(docs_frame(spark, rows), path, with_ids=True).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = dict(rows)
    assert all(r.round_trip and sp.decode(r.ids) == (text[r.doc_id] or "") for r in got)
    assert sum(r.doc_id == 900 for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 2
    again = segment.sample(docs_frame(spark, rows[::-1]).repartition(3), path, with_ids=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    encoded = segment.encode(docs_frame(spark, rows), path)
    assert collections.Counter((r.doc_id, r.text) for r in segment.decode(encoded, path).collect()) == collections.Counter((i, t or "") for i, t in rows)


def test_preferences(spark):
    turns = [
        (1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (3, 0, "user", "q"), (3, 1, "assistant", "yes"),
        (4, 0, None, None), (5, 1, "assistant", "b"), (5, 0, "user", "z"), (5, 0, "user", "z"), (None, 0, "user", "lost"),
    ]
    got = {r.conv_id: r for r in preference.formatted(preference.paired(preference.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    t = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    r = got[2]
    assert (r.chosen_id, r.rejected_id, r.n_common, r.prompt, r.chosen, r.rejected) == (1, 2, 1, t("user", "q"), t("assistant", "yes"), t("assistant", "no") + t("user", "why"))
    a, b = map(int, r.rejected_mask.split("-"))
    assert r.rejected[a:b] == "no<|im_end|>\n"
    assert got[3].n_common == 2 and got[3].chosen == got[3].rejected == got[3].chosen_mask == ""
    assert got[5].rejected is None and got[5].prompt == t("user", "z") and got[5].chosen == t("assistant", "b")
    assert got[4].prompt == t("user", "") and len(got) == 6
    seg = spark.createDataFrame([(r.rejected, r.rejected_mask)], "t string, m string").select(preference.segments(F.col("t"), F.col("m")).alias("s")).first().s
    assert "".join(x.text for x in seg) == r.rejected and [x.text for x in seg if x.train] == ["no<|im_end|>\n"]


def test_licences(spark):
    mit = " ".join(license_scan._MIT)
    wrapped = re.sub(r"(\w+ \w+ \w+ \w+) ", r"\1\n", mit)
    bsd3 = "\n\n".join((*license_scan._BSD, license_scan._BSD_NAME))
    rows = [(1, mit), (2, "noise\n" + wrapped + "\nmore"), (3, bsd3), (4, "\n\n".join(license_scan._BSD)), (5, "A line\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0. And on."), (6, "unlicensed under nothing")]
    got = {r.doc_id: r for r in license_scan.scan(docs_frame(spark, rows + ODD)).collect()}
    assert [got[k].licenses for k in range(1, 7)] == ["MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0,CC-BY-NC-4.0", ""]
    assert dict(rows)[5][got[5].spans[0].start : got[5].spans[0].end] == "Licensed under CC BY-NC 4.0." and got[900].n_licenses == 0


def test_licence_query_against_plain_search(spark):
    """Over all documents of sf0.01: a rule matches where the words of its sentences follow one another."""
    from sparkloom.llm import queries

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r.licenses for r in queries.op5_license_scan(spark, folder).collect()}
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rules = [(name, re.compile(" (?:.* )?".join(re.escape(license_scan.normal(x)) for x in parts))) for name, parts in license_scan.RULES]
    for row in rows:
        flat = license_scan.normal(row["text"] or "")
        assert got[row["doc_id"]] == ",".join(sorted({name for name, rule in rules if rule.search(flat)}))
    assert len(got) == len(rows) and len(set(got.values())) > 4


def test_toxicity_query_on_held_out_rows(spark):
    """Over all documents of sf0.1, on the labelled rows that the lexicon isn't learned from. Some labels are wrong: 9 of 144 toxic rows hold no entry at all."""
    from sparkloom.llm import queries

    folder = "/root/testdata/sf0.1"
    found = queries.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    hit, missed, wrong, right = found.selectExpr("count_if(predicted = 1 and toxic = 1)", "count_if(predicted = 0 and toxic = 1)", "count_if(predicted = 1 and toxic = 0)", "count_if(predicted = 0 and toxic = 0)").first()
    assert hit >= 0.9 * (hit + missed) and wrong <= 0.01 * (wrong + right) and hit > 100


def test_licence_families_are_told_apart():
    table = license_scan.Rules.of(license_scan.RULES)
    named = lambda *parts: [x[0] for x in license_scan.matches(license_scan.sentence_ids("\n\n".join(parts), table), table)]
    bsd, name, advert = license_scan._BSD, license_scan._BSD_NAME, license_scan._BSD_ADVERTISING
    assert named(*bsd) == ["BSD-2-Clause"] and named(*bsd, name) == ["BSD-3-Clause"] and named(*bsd, advert, name) == ["BSD-4-Clause"]
    assert named(license_scan._GNU[0]) == ["GPL-3.0-or-later"] and named(license_scan._GNU_2[0]) == ["GPL-2.0-or-later"] and named(license_scan._LGPL_3) == ["LGPL-3.0-or-later"] and named(license_scan._AGPL) == ["AGPL-3.0-or-later"]
    assert named("All rights reserved.") == ["LicenseRef-Proprietary"] and named("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later"] and named("SPDX-License-Identifier: GPL-9") == []


def test_every_licence_rule_is_found_in_its_own_text():
    table = license_scan.Rules.of(license_scan.RULES)
    for name, parts in license_scan.RULES:
        for text in (" ".join(parts), "\n\n".join(parts), "Some words before. " + re.sub(r"(\w+ \w+ \w+) ", r"\1\n# ", " ".join(parts)) + "\n\nAnd words after."):
            assert [x[0] for x in license_scan.matches(license_scan.sentence_ids(text, table), table)] == [name], text
    notice = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    text = f"/* {notice} If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    [(name, a, b)] = license_scan.matches(license_scan.sentence_ids(text, table), table)
    assert name == "MPL-2.0" and text[a:b].endswith(notice)
    assert not license_scan.matches(license_scan.sentence_ids(notice.replace("v. 2.0", "v.\n\n2.0"), table), table)


def test_html_held_out_accuracy():
    rng, right, total = np.random.default_rng(1234), 0, 0
    for _ in range(120):
        found = html_text.blocks(html_text.generated(rng))
        y = np.array(["\x01" in b.text for b in found])
        for b in found:
            b.text = b.text.replace("\x01", "")
        p = html_text.trained().probabilities(*html_text.padded([html_text.vectors(found)]))[0]
        right, total = right + int(((p >= 0.5) == y).sum()), total + len(y)
    assert right / total > 0.985


def test_html_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad --><div class="ad">Buy it now.</div><article><h1>Some title here</h1><p><b>First   part &amp; more.<br><p>Second\npart &lt;tag&gt;.</article><footer>&copy; site &middot; Words here.</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<<<>\"' <p"), (5, "u", "<script>x</script>"), (5, "u", "<b>" * 500)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "Some title here First part & more. Second part <tag>." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and len(got) == 6


def test_html_pages_equal_their_articles():
    """The pages of the smallest test tables, against the text between their article tags without what is nested there."""
    pages = pq.read_table(SMALL + "/pages.parquet")["html"].to_pylist()
    got = html_text.texts(html_text.trained(), pages)
    for page, text in zip(pages, got, strict=True):
        body = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.DOTALL)[1]
        body = re.sub(r"<(nav|aside|form|script|style|header|footer)\b.*?</\1>|<div class=\"(?:ad|share|notice|comments).*?</div>", " ", body, flags=re.DOTALL)
        want = html.unescape(re.sub(r"<[^>]+>", " ", body))
        assert text.split() == want.split()
        assert "".join(text.split(" ")) == "".join(text.split()) and text == text.strip()


def test_html_texts_of_the_next_larger_tables():
    """The 250 pages that the README counts: as the smaller ones, against their articles."""
    pages = pq.read_table(SMALL.replace("sf0.001", "sf0.01") + "/pages.parquet")["html"].to_pylist()
    assert len(pages) == 250
    for page, text in zip(pages, html_text.texts(html_text.trained(), pages), strict=True):
        body = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.DOTALL)[1]
        body = re.sub(r"<(nav|aside|form|script|style|header|footer)\b.*?</\1>|<div class=\"(?:ad|share|notice|comments).*?</div>", " ", body, flags=re.DOTALL)
        assert text.split() == html.unescape(re.sub(r"<[^>]+>", " ", body)).split()


def test_html_deep_and_unclosed_pages_take_linear_time_and_memory():
    for unit, n, found in (("<div>a ", 50_000, 50_000), ("<b>a ", 50_000, 1), ("<title>a ", 50_000, 50_000), ("<b>x</i>", 50_000, 1), ("<svg>", 50_000, 0), ("<a>" * 9 + "<li>b", 20_000, 20_000)):
        tracemalloc.start()
        began = time.time()
        got = html_text.blocks(unit * n)
        x = html_text.vectors(got) if got else None
        took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == found and took < 20 and peak < 200e6, (unit, took, peak)
        assert unit != "<div>a " or np.abs(x[-1, : html_text.PATH_DIM]).max() >= n - 1  # the whole path is in the vector


def test_html_labeller_reads_whole_blocks_and_paths():
    block = lambda path, text: html_text.vectors([html_text.Block(path, text, 0)])[0]
    words = " ".join(f"w{k}" for k in range(500))
    kept = slice(html_text.PATH_DIM, html_text.PATH_DIM + html_text.WORD_DIM)
    assert (block(("p",), words + " other")[kept] != block(("p",), words + " words")[kept]).any()
    deep = ("table", "tbody", "tr", "td") * 5
    assert (block(("footer", *deep), "x")[: html_text.PATH_DIM] != block(("article", *deep), "x")[: html_text.PATH_DIM]).any()
    [text] = html_text.texts(html_text.trained(), ["<article><h1>Title</h1><p>" + "Long words here. " * 100_000 + "</p></article><div class=footer>" + "<div>" * 2000 + "&copy; site" + "</div>" * 2000 + "</div>"])
    assert text.startswith("Title Long words") and len(text) == 6 + 17 * 100_000 - 1


def test_html_hidden_elements_end_where_they_should():
    found = lambda page: [b.text for b in html_text.blocks(page)]
    text = ["Kept one.", "Kept two."]
    body = "<article><p>Kept one.</p><p>Kept two.</p></article>"
    for before, after in (
        ('<svg class="i"/>', "<svg><text>no</text></svg>"), ("<math/>", "<math></math>"), ("<svg><g>", "<svg></svg>"), ('<script src="a.js"/>', "<script>no()</script>"),
        ("<datalist id=d><option>no<option>no</datalist>", "<select><option>no</option></select>"), ("<option>no", "<option>no</option>"), ("<video src=v>", "<video>no</video>"),
        ("<div><svg><g>no</div>", "<svg></svg>"), ("<select><option>no</option>", "<p></p>"), ("<svg><svg>no</svg>no<foreignObject><div>no</div></foreignObject></svg>", ""),
    ):
        got = found(f"<body>{before}{body}{after}</body>")
        assert [x for x in got if x != "no"] == text and (got == text or before.startswith("<select>")), before
    assert found("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows.</p>") == ["As x=2 shows."]
    assert found("<object data=a><p>Instead.</p></object><noscript><p>Without.</p></noscript>") == ["Instead.", "Without."]
    assert found("<p>a <select><option>no<option>no</select> b</p><script>no</script><textarea><p>no</textarea>") == ["a", "b"]
    assert [b.path for b in html_text.blocks("<p>a <svg><path/></svg> b</p>")] == [("p",), ("p",)]


def test_gradients():
    rng = np.random.default_rng(0)
    model, size = html_text.Labeller(1), html_text.PATH_DIM + html_text.WORD_DIM + html_text.NUMBERS
    x, mask = html_text.padded([rng.normal(size=(4, size)), rng.normal(size=(2, size))])
    y = rng.integers(0, 2, mask.shape) * mask

    def loss():
        p = model.probabilities(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for k, g in model.gradients(x, mask, y).items():
        at = tuple(rng.integers(s) for s in g.shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))) for k in range(30)]
    item = " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(14))
    rows = clean + [(100 + k, t) for k, t in clean[:5]] + [(200, clean[0][1] + " " + item)] + [(300 + k, t + " utter scoundrel") for k, t in clean]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {i for i, _ in clean}
    assert kept[0] == ids | set(range(100, 105)) | {200} and kept[1] == ids | {200} - ({200} if near_classes(rows[:1] + [rows[35]])[1] == 0 else set()) and kept[2] == ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)
    assert json.dumps(sorted(r.rank for r in out)) == json.dumps([0] * len(ids) + [1] * len(ids))


def test_pipeline_stages_judge_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    text = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(60)]
    item = " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(14))
    bad, leak = " utter scoundrel", " " + item
    rows = [(k, t) for k, t in enumerate(text[:30])] + [(300 + k, t + bad) for k, t in enumerate(text[:30])]
    rows += [(None, text[30]), (None, text[31]), (None, text[31]), (None, text[32] + bad), (None, text[33] + leak), (None, text[0]), (None, None), (None, "")]
    rows += [(300, text[34]), (400, text[35] + leak), (400, text[36]), (500, text[37]), (500, text[37]), (501, text[38]), (501, text[39])]
    want = {t: k for k, t in enumerate(text[:30])} | {text[30]: None, text[31]: None, None: None, "": None, text[34]: 300, text[36]: 400, text[37]: 500, text[38]: 501, text[39]: 501}
    frame = lambda x: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in x], "doc_id long, text string, lang string, source string, n_chars long")
    frame(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(300 <= i < 400)) for i in range(330)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    docs, gone = spark.read.parquet(str(tmp_path / "documents.parquet")), lambda mark: [x for x in rows if mark not in (x[1] or "")]
    clean = corpus_pipeline.not_toxic(spark, docs, str(tmp_path))
    assert plain(clean) == collections.Counter(gone(bad))
    single = {(i, t): 1 for t, i in want.items()}
    for source in (clean, frame(gone(bad))):
        assert plain(corpus_pipeline.not_repeated(spark, source, str(tmp_path))) == single | {(None, text[33] + leak): 1, (400, text[35] + leak): 1}
    assert plain(corpus_pipeline.not_benchmark(spark, docs, str(tmp_path))) == collections.Counter(gone(leak))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.rank == 0) == sorted((i is None, i or 0) for i in want.values())


def test_comparison_across_roots_against_brute_force():
    """Blocks compared as a whole give the same links of roots as one pair after another."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 6), replace=False):
            words[at] = f"x{rng.integers(3)}"
        texts.append(" ".join(words + words[: rng.integers(0, 4)]))
    texts += ["", "a", "a b"]
    split = W.split(pa.array(texts))
    nodes = minhash.node_keys(split)
    doc, value, weight = W.bag(split, 5)
    bags = [dict(zip(value[doc == k].tolist(), weight[doc == k].tolist(), strict=True)) for k in range(len(texts))]
    rows = [{"node": n, "n": sum(bags[k].values()), "root": bytes([k]), "keys": [1, k % 2], "text": texts[k]} for k, n in enumerate(nodes)]

    def close(a: int, b: int) -> bool:
        common = sum(min(w, bags[b].get(v, 0)) for v, w in bags[a].items())
        union = sum(bags[a].values()) + sum(bags[b].values()) - common
        return common > 0 and common / union >= 0.8

    def groups(pairs) -> set[frozenset]:
        found = {r["root"]: {r["root"]} for r in rows}
        for u, v in pairs:
            both = found[u] | found[v]
            for x in both:
                found[x] = both
        return {frozenset(x) for x in found.values()}

    expected = groups((rows[a]["root"], rows[b]["root"]) for a in range(len(rows)) for b in range(len(rows)) if close(a, b))
    found = minhash._across(rows, rows[:20], 5, 0.8)
    some = groups((rows[a]["root"], rows[b]["root"]) for a in range(20) for b in range(len(rows)) if close(a, b))
    assert groups(found) == some
    assert groups(minhash._across(rows, rows, 5, 0.8)) == expected
    assert found and 1 < len(expected) < len(rows) and all(u != v for u, v in found)
    left, right = minhash.Bags(pa.array(texts), 5), minhash.Bags(pa.array(texts[::-1]), 5)
    common = [sum(min(w, bags[-1 - k].get(v, 0)) for v, w in bags[k].items()) for k in range(len(texts))]
    assert left.common(right).tolist() == common


def test_distances_between_lists_take_little_memory():
    import tracemalloc

    from sparkloom.llm import vectors

    rng = np.random.default_rng(4)
    sample = rng.normal(size=(16 * 512, 256))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    tracemalloc.start()
    pq = vectors.Quantiser(sample, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.sqrt(((pq.coarse[:8, None] - pq.coarse[None]) ** 2).sum(2))
    exact[exact == 0] = np.inf
    assert (pq.between[:8] >= exact).all() and np.isclose(pq.between[:8], exact, rtol=1e-6).all()
    assert peak < 512 * 512 * 256 * 8 / 2


def test_vectors_of_one_large_label_among_many_small_ones(spark):
    from sparkloom.llm import vectors

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = [centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.02, 0.2]) for _ in range(900)]
    rows = [(k, [float(np.float32(a)) for a in v], 0 if k < 600 else k) for k, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows[:600]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.93).sum(1) - 1
    assert [got[k] for k in range(600)] == want.tolist() and all(got[k] == 0 for k in range(600, 900))
