"""Chat templates of two model families as column expressions: the text that a model is trained on, byte for byte.

A rendering is an array of pieces, what stands before the turns and then one piece for each turn, so that places of turns in
the whole are sums of lengths. Turns are rendered by built-in functions; only the descriptions of tools, JSON in a text column
with few distinct values, are made by a small helper in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of the templates.
START, END = "<|im_start|>", "<|im_end|>"
BEGIN = {"qwen25": "", "hermes2pro": "<|begin_of_text|>"}
QWEN_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
QWEN_TOOLS = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
QWEN_CALLS = "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call><|im_end|>\n"
HERMES_TOOLS = "You are a function calling AI model. You are provided with function signatures within <tools></tools> XML tags. You may call one or more functions to assist with the user query. Don't make assumptions about what values to plug into functions. Here are the available tools: <tools> "
HERMES_SCHEMA = ' </tools>Use the following pydantic model json schema for each tool call you will make: {"properties": {"name": {"title": "Name", "type": "string"}, "arguments": {"title": "Arguments", "type": "object"}}, "required": ["name", "arguments"], "title": "FunctionCall", "type": "object"}}\n'
HERMES_CALLS = 'For each function call return a json object with function name and arguments within <tool_call></tool_call> XML tags as follows:\n<tool_call>\n{"name": <function-name>, "arguments": <args-dict>}\n</tool_call><|im_end|>\n'
PYTHON_TYPES = {"string": "str", "number": "float", "integer": "int", "boolean": "bool"}
_NONE = object()


def _dumped(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def python_type(kind: Any, extra: Any = _NONE) -> str:
    """The Python name of a JSON type; extra: the schema of an object's other properties. A schema without a type, and the items of a list, are an empty union."""
    if kind is _NONE:
        return "Union[]"
    if isinstance(kind, str):
        if kind == "object":
            return "dict" if extra is _NONE else f"dict[str, {schema_type(extra)}]"
        return "list[Union[]]" if kind == "array" else PYTHON_TYPES.get(kind, "Any")
    return f"Union[{','.join(map(python_type, kind))}]" if isinstance(kind, (list, dict)) else "Any"


def schema_type(schema: Any) -> str:
    fields = schema if isinstance(schema, dict) else {}
    return python_type(fields.get("type", _NONE), fields.get("additionalProperties", _NONE))


def _signature(tool: dict[str, Any]) -> str:
    """One tool as the second family's template describes it: a Python signature, its arguments, and the schema."""
    tool = tool.get("function", tool)
    parameters = tool.get("parameters", {})
    fields = parameters.get("properties") or {}
    given = tool.get("return")
    arguments = ", ".join(f"{name}: {schema_type(x)}" for name, x in fields.items())
    described = "".join(f"        {name}({schema_type(x)}): {str(x.get('description', '')).strip()}" for name, x in fields.items())
    out = f'{{"type": "function", "function": {{"name": "{tool["name"]}", "description": "{tool["name"]}({arguments})'
    out += (f" -> {schema_type(given)}" if "return" in tool else "") + f" - {tool['description']}\n\n" + ("    Args:\n" + described if fields else "")
    if isinstance(given, dict) and "description" in given:
        out += f"\n    Returns:\n        {given['description']}"
    return out + '", "parameters": ' + (_dumped(parameters) if fields else "{}") + "}"


@lru_cache(maxsize=1024)
def _tools_text(tools: str | None, adapter: str) -> str | None:
    try:
        listed = json.loads(tools) if tools else None
    except ValueError:
        return None
    if not isinstance(listed, list) or not listed:
        return None
    return "".join("\n" + _dumped(x) for x in listed) if adapter == "qwen25" else "\n".join(map(_signature, listed))


def tools_text(tools: Column, adapter: str) -> Column:
    """What the template says of the tools (a JSON list); null where there are none or the text is no list. A tool without name or description is an error."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: _tools_text(x, adapter))

    return text(tools)


def pick_template(tools: Column) -> Column:
    """tool_use where there are tools, default otherwise."""
    listed = F.try_parse_json(tools)
    return F.when(F.coalesce(F.schema_of_variant(listed).startswith("ARRAY") & (F.trim(tools) != "[]") & F.try_variant_get(listed, "$[0]", "variant").isNotNull(), F.lit(False)), F.lit("tool_use")).otherwise(F.lit("default"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def _calls(calls: Column) -> Column:
    one = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
    return F.array_join(F.transform(calls, one), "")


def pieces(messages: Column, tools: Column | None = None, *, adapter: str = "qwen25", calls: bool = False, generation: bool = False) -> Column:
    """The rendering in pieces: what precedes the turns, one piece for each turn, and the opening of an answer if asked for.

    messages: structs of role and content, with ``calls`` also of tool_calls, structs of name and arguments (JSON text as it is to
    stand). Null roles and contents are empty; null messages give null. tools: a JSON list, or null. Turns of roles that a template
    doesn't know render as nothing.
    """
    if adapter not in BEGIN:
        raise ValueError(f"unknown adapter {adapter}")
    lit, text = F.lit, lambda m: F.coalesce(m["content"], F.lit(""))
    role = lambda m: F.coalesce(m["role"], F.lit(""))
    described = tools_text(tools, adapter) if tools is not None else lit(None).cast("string")
    at = lambda i: F.coalesce(F.get(messages, i)["role"], lit(""))
    last = lambda i: i == F.size(messages) - 1
    has_calls = (lambda m: F.coalesce(F.size(m["tool_calls"]) > 0, lit(False))) if calls else lambda m: lit(False)
    called = (lambda m: _calls(m["tool_calls"])) if calls else lambda m: lit("")

    def qwen(m: Column, i: Column) -> Column:
        plain = (role(m) == "user") | ((role(m) == "system") & (i > 0)) | ((role(m) == "assistant") & ~has_calls(m))
        answer = F.concat(F.when((i == 0) | (at(i - 1) != "tool"), f"{START}user").otherwise(""), lit("\n<tool_response>\n"), text(m), lit("\n</tool_response>"), F.when(last(i) | (at(i + 1) != "tool"), f"{END}\n").otherwise(""))
        acting = F.concat(lit(f"{START}assistant"), F.when(text(m) != "", F.concat(lit("\n"), text(m))).otherwise(""), called(m), lit(f"{END}\n"))
        return F.when(plain, _turn(role(m), text(m))).when(role(m) == "assistant", acting).when(role(m) == "tool", answer).otherwise("")

    def hermes(m: Column, i: Column) -> Column:
        plain = role(m).isin("user", "system") | ((role(m) == "assistant") & ~has_calls(m))
        opened = F.when((i > 0) & (at(i - 1) != "tool"), f"{START}tool\n").otherwise("")
        closed = F.when(last(i), f"\n</tool_response>{END}").otherwise(F.concat(lit("\n</tool_response>\n"), F.when(at(i + 1) != "tool", END).otherwise("")))
        answer = F.concat(opened, lit("<tool_response>\n"), text(m), closed)
        return F.when(plain, _turn(role(m), text(m))).when(role(m) == "assistant", F.concat(lit(f"{START}assistant"), called(m), lit(f"{END}\n"))).when(role(m) == "tool", answer).otherwise("")

    if adapter == "qwen25":
        system = F.when(at(lit(0)) == "system", text(F.get(messages, 0))).otherwise(QWEN_SYSTEM)
        bare = _turn(lit("system"), system)
        head = F.when(described.isNull(), bare).otherwise(F.concat(lit(f"{START}system\n"), system, lit(QWEN_TOOLS), described, lit(QWEN_CALLS)))
        turns = F.transform(messages, qwen)
    else:
        head = F.concat(lit(BEGIN[adapter]), F.when(described.isNull(), "").otherwise(F.concat(lit(f"{START}system\n{HERMES_TOOLS}"), described, lit(HERMES_SCHEMA + HERMES_CALLS))))
        turns = F.when(described.isNull(), F.transform(messages, lambda m: _turn(role(m), text(m)))).otherwise(F.transform(messages, hermes))
    return F.concat(F.array(head), turns, F.array(lit(f"{START}assistant\n")) if generation else F.array().cast("array<string>"))


def render(messages: Column, tools: Column | None = None, *, adapter: str = "qwen25", calls: bool = False, generation: bool = False) -> Column:
    """The rendered conversation, see ``pieces``."""
    return F.array_join(pieces(messages, tools, adapter=adapter, calls=calls, generation=generation), "")


def first_difference(a: Column, b: Column) -> Column:
    """The byte (from 0) at which two texts differ first, the length of the shorter one where it begins the other, null where they're equal or one is null."""
    x, y = F.encode(a, "utf-8"), F.encode(b, "utf-8")
    more = lambda n, step: F.when(F.substring(x, F.lit(1), n + step) == F.substring(y, F.lit(1), n + step), n + step).otherwise(n)
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    # the longest common prefix by halving: 31 comparisons, whatever the length
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    common = F.aggregate(steps, F.lit(0), lambda n, step: F.when(n <= shorter - step, more(n, step)).otherwise(n))
    return F.when(a != b, common)


def parity(rows: DataFrame, left: str, right: str, keys: Iterable[str] = ("id",)) -> DataFrame:
    """keys, same and first_byte, where two renderings part; null texts are the same only as each other, and part at 0."""
    a, b = F.col(left), F.col(right)
    found = F.when(a.isNull() != b.isNull(), 0).otherwise(first_difference(a, b))
    return rows.select(*keys, a.eqNullSafe(b).alias("same"), found.cast("int").alias("first_byte"))
