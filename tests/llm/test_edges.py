"""Every operator on empty tables, on tables whose extra columns clash with names used inside, and on texts of several MB."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontaminate, html_text, license_scan, minhash, preference, segment, token_output, toxicity, url_filter, vectors
from sparkloom.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
BENCH = "item_id long, text string"
# Names that operators give to columns of their own.
CLASHES = ("id", "node", "component_id", "kept", "n", "kind", "copies", "u", "v", "row_key", "start", "rank", "score", "host", "rule", "turns", "chosen_id", "k", "_place", "band", "root")
LEXICON = toxicity.learn([(f"text {k} of a scumbag" if k % 2 else f"text {k} of a friend", k % 2) for k in range(60)])


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return public_tokenizers


def operators(spark, tokenizers):
    """name -> (schema of the table, the operator)"""
    bench = lambda: spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None), (3, "")], BENCH)
    return {
        "op1": (VECTORS, lambda d: vectors.near_vectors(d)),
        "op2": (DOCS, lambda d: segment.sample(d, tokenizers.path("piece_bpe_32k.model"))),
        "op3": (DOCS, lambda d: token_output.round_trip(d, tokenizers.path("word_bpe_49k.json"))),
        "op4": (TURNS, lambda d: preference.formatted(preference.paired(preference.conversations(d)))),
        "op5": (DOCS, lambda d: license_scan.scan(d)),
        "op6": (PAGES, lambda d: url_filter.judge(d, url_filter.build(spark, iter(URL_RULES)))),
        "op7": (DOCS, lambda d: toxicity.score(d, LEXICON)),
        "op8": (PAGES, lambda d: html_text.extract(d)),
        "op9": (DOCS, lambda d: decontaminate.scan(d, bench())),
        "op10": (DOCS, lambda d: minhash.near_duplicates(d)),
    }


NAMES = [f"op{k}" for k in range(1, 11)]
ROWS = {
    DOCS: [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 5), (2, "one two three four five six seven eight nine ten eleven twelve", None, None, None), (None, "a scumbag without id", "en", "s", 1),
        (3, None, "de", "s", None), (4, "", "de", "s", 0), (4, "", "de", "s", 0), (5, "Licensed under CC BY 4.0. All rights reserved.", "en", None, 3),
    ],
    PAGES: [(1, "https://a.example.com/en/7x?q", "<p>some words of an article that are long enough to be read as one</p>"), (None, None, None), (2, "", ""), (2, "", ""), (3, "no scheme", None)],
    VECTORS: [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [1.0, 0.0], None), (7, [], 0)],
    TURNS: [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, None, "assistant", "b"), (2, 1, None, None), (None, 0, "user", "q"), (None, 0, "user", "q")],
}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tokenizers, name):
    schema, run = operators(spark, tokenizers)[name]
    out = run(spark.createDataFrame([], schema))
    assert out.columns and out.collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_change_nothing(spark, tokenizers, name):
    schema, run = operators(spark, tokenizers)[name]
    plain = spark.createDataFrame(ROWS[schema], schema)
    extra = [c for c in CLASHES if c not in plain.columns]
    wide = plain.select(*(F.lit(None).cast("string").alias(c) if k % 2 else F.lit("x").alias(c) for k, c in enumerate(extra)), *plain.columns)
    want, got = run(plain), run(wide)
    assert want.columns == got.columns
    known = sorted(str(r) for r in want.collect())
    assert known and known == sorted(str(r) for r in got.collect())


def test_very_long_texts(spark, tokenizers):
    sentence = "Some words of a long text that goes on, line after line.\n"
    long = sentence * 50_000 + "one two three four five six seven eight nine ten eleven. Licensed under CC BY 4.0. scumbag"
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, "short", "en", "s", 5), (3, long, "en", "s", len(long))], DOCS)
    ops = operators(spark, tokenizers)
    row = {name: {r[0]: r for r in ops[name][1](docs).collect()} for name in ("op3", "op5", "op7", "op9")}
    assert row["op3"][1].n_tokens == row["op3"][3].n_tokens > 500_000 and row["op3"][1].ids_crc32 == row["op3"][3].ids_crc32
    assert row["op5"][1].licenses == "CC-BY-4.0" and row["op9"][1].n_hit == 11 and not row["op9"][2].contaminated
    assert row["op7"][1].score > row["op7"][2].score
    groups = {r.doc_id: r.component_id for r in ops["op10"][1](docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}
    page = spark.createDataFrame([(1, "u", "<body>" + "<p>" + sentence * 20_000 + "</p></body>"), (2, "u", "<div>" * 20_000 + "deep" + "<a" * 20_000)], PAGES)
    assert {r.page_id for r in ops["op8"][1](page).collect()} == {1, 2}


def test_sampled_segmentations_of_a_very_long_text(spark, tokenizers):
    long = "Some words of a long text that goes on. " * 50_000
    got = segment.sample(spark.createDataFrame([(1, long)], "doc_id long, text string"), tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == segment.SAMPLES and all(r.round_trip for r in got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_documents(spark, tmp_path, name, stage):
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", BENCH)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).collect() == []
