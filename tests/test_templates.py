"""Renderings against texts written out by hand, loss spans against the definition by prefixes, and rules that once answered wrongly."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import templates
from sparkloom.functions.chat_json import tool_calls
from sparkloom.functions.tokens import piece_ends, rendered_pieces, token_count
from sparkloom.operators import listing, preflight, rules, sessions

ROWS = "id long, messages array<struct<role: string, content: string>>, tools string"
TOOLS = '[{"type": "function", "function": {"name": "look", "description": "Looks.", "parameters": {"type": "object", "properties": {"at": {"type": "string", "description": "where"}}}}}, {"name": "wait", "description": "Waits.", "parameters": {"properties": {}}}]'


def one(spark, messages, tools=None, **how):
    rows = spark.createDataFrame([(1, messages, tools)], ROWS)
    return rows.select(templates.render(F.col("messages"), F.col("tools"), **how)).first()[0]


def test_plain_turns(spark):
    turns = [("system", "S"), ("user", "U"), ("assistant", "A")]
    body = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n"
    assert one(spark, turns) == body
    assert one(spark, turns, adapter="hermes2pro") == "<|begin_of_text|>" + body
    assert one(spark, turns[1:], "[]", generation=True) == "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n" + body[len("<|im_start|>system\nS<|im_end|>\n") :] + "<|im_start|>assistant\n"
    assert one(spark, None) is None and one(spark, [("user", None)], adapter="hermes2pro") == "<|begin_of_text|><|im_start|>user\n<|im_end|>\n"
    with pytest.raises(ValueError):
        templates.pieces(F.col("messages"), adapter="other")


def test_tools_and_tool_turns(spark):
    turns = [("system", "S"), ("user", "U"), ("assistant", "<tool_call>\n{}\n</tool_call>"), ("tool", "r1"), ("tool", "r2"), ("assistant", "done"), ("tool", "end")]
    got = one(spark, turns, TOOLS)
    assert got.startswith("<|im_start|>system\nS\n\n# Tools\n\nYou may call") and '<tools>\n{"type": "function", "function": {"name": "look"' in got
    assert got.endswith(
        "<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n<tool_call>\n{}\n</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
        "<|im_start|>assistant\ndone<|im_end|>\n<|im_start|>user\n<tool_response>\nend\n</tool_response><|im_end|>\n"
    )
    got = one(spark, turns, TOOLS, adapter="hermes2pro")
    assert got.startswith("<|begin_of_text|><|im_start|>system\nYou are a function calling AI model.")
    assert (
        'Here are the available tools: <tools> {"type": "function", "function": {"name": "look", "description": "look(at: str) - Looks.\n\n    Args:\n        at(str): where", "parameters": {"type": "object", "properties": {"at": {"type": "string", "description": "where"}}}}\n'
        '{"type": "function", "function": {"name": "wait", "description": "wait() - Waits.\n\n", "parameters": {}} </tools>Use the following' in got
    )
    assert got.endswith(
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n<tool_call>\n{}\n</tool_call><|im_end|>\n<|im_start|>tool\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response>\n<|im_end|>"
        "<|im_start|>assistant\ndone<|im_end|>\n<|im_start|>tool\n<tool_response>\nend\n</tool_response><|im_end|>"
    )


def test_calls_as_fields_render_as_embedded_ones(spark):
    schema = "messages array<struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string>>>>, tools string"
    call = ("look", '{"at": "ไฟล์"}')
    apart = spark.createDataFrame([([("user", "U", None), ("assistant", None, [call, call]), ("assistant", "A", [])], TOOLS)], schema)
    block = '<tool_call>\n{"name": "look", "arguments": {"at": "ไฟล์"}}\n</tool_call>'
    inside = [("user", "U"), ("assistant", f"{block}\n{block}"), ("assistant", "A")]
    for adapter in ("qwen25", "hermes2pro"):
        assert apart.select(templates.render(F.col("messages"), F.col("tools"), adapter=adapter, calls=True)).first()[0] == one(spark, inside, TOOLS, adapter=adapter)


def test_types_of_schemas():
    t = templates.schema_type
    assert [t({"type": x}) for x in ("string", "number", "integer", "boolean", "array", "object", None)] == ["str", "float", "int", "bool", "list[Union[]]", "dict", "Any"]
    assert t({"type": ["string", "integer"]}) == "Union[str,int]" and t({}) == "Union[]" and t({"type": "object", "additionalProperties": {"type": "integer"}}) == "dict[str, int]"


def test_first_difference(spark):
    pairs = [("abc", "abc", None), ("abc", "abd", 2), ("abc", "ab", 2), ("", "x", 0), ("é", "è", 1), ("x" * 70_000 + "a", "x" * 70_000 + "b", 70_000), (None, "x", None)]
    rows = spark.createDataFrame(pairs, "a string, b string, at int")
    assert all(r.got == r.at for r in rows.select("at", templates.first_difference(F.col("a"), F.col("b")).alias("got")).collect())
    found = templates.parity(spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "ab", "ac")], "id long, a string, b string"), "a", "b")
    assert {r.id: (r.same, r.first_byte) for r in found.collect()} == {1: (False, 0), 2: (True, None), 3: (False, 1)}


def test_spans_in_one_pass_equal_those_of_prefixes(spark):
    import public_tokenizers

    rng = random.Random(5)
    words = ["one", "two,", "\n", "  ", "drei", "é", "สวัสดี", "4711", "", "end.\n"]
    rows = [(k, [(rng.choice(["user", "assistant", "tool", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 9))], rng.choice([None, "", "tools: []\n"])) for k in range(60)]
    rows.append((60, [("assistant", None)], None))
    df = spark.createDataFrame(rows, ROWS)
    path = public_tokenizers.path("word_bpe_49k.json")
    for ends, count in ((lambda p: piece_ends(p), F.char_length), (lambda p: piece_ends(p, path), lambda c: token_count(c, path))):
        want = sorted(map(tuple, preflight.loss_spans(df, count).collect()))
        assert want and want == sorted(map(tuple, preflight.assistant_spans(df, ends, rendered_pieces).collect()))
    hermes = preflight.assistant_spans(df, lambda p: piece_ends(p, path), lambda m, t: templates.pieces(m, t, adapter="hermes2pro"))
    assert {r.turn for r in hermes.collect()} == {r[1] for r in want}


def test_errors_are_judged_as_json_values(spark):
    cases = {'{"error": "0"}': True, '{"error": "false"}': True, '{"error": "null"}': True, '{"error": "[]"}': True, '{"error": ""}': False, '{"error": 0.0}': False, '{"error": 0}': False, '{"error": 2}': True, '{"error": -0.5}': True,
             '{"error": false}': False, '{"error": true}': True, '{"error": null}': False, '{"error": []}': False, '{"error": [0]}': True, '{"error": {}}': False, '{"error": {"a": null}}': True, '{"status": "error"}': True,
             '{"content": "an Exception"}': True, '{"content": "fine"}': False, "{}": False, "no json": False}
    rows = spark.createDataFrame(list(cases.items()), "data string, want boolean")
    wrong = rows.where(sessions.is_error(F.col("data")) != F.col("want")).collect()
    assert wrong == []


def test_closing_tags_are_stray_only_beyond_those_of_blocks():
    assert tool_calls("</tool_call><tool_call>")[1] == ["unclosed_tag"]
    assert tool_calls("</tool_call>")[1] == ["stray_close_tag"]
    assert tool_calls('<tool_call>{"name": "a", "arguments": {}}</tool_call></tool_call>')[1] == ["stray_close_tag"]


def test_partial_files_are_errors_in_loop_examples_too():
    call = '<tool_call>\n{"name": "write_file", "arguments": {"path": "a.py", "content": "x = 1\\n... rest of the file"}}\n</tool_call>'
    turns = [{"role": "user", "content": "u"}, {"role": "assistant", "content": call}, {"role": "tool", "content": "ok"}, {"role": "assistant", "content": "done"}]
    for category in ("tool", "loop"):
        assert "T6" in {v["code"] for v in rules.category_violations(category, turns)}


def test_histogram_counts_unknown_sizes_apart(spark):
    rows = spark.createDataFrame([(None,), (1,), (512,), (513,), (99_999,)], "n long")
    assert {r.bucket: r.n for r in listing.length_histogram(rows, "n").collect()} == {-1: 1, 0: 2, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
