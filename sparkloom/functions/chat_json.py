"""Strict JSON and tool calls in messages: the semantics that built-in JSON functions don't have, in Arrow-batched functions."""

from __future__ import annotations

import json
import re
from typing import Any

from sparkloom.schema import TOOLS

_OPEN, _CLOSE = "<tool_call>", "</tool_call>"
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def strict_object(text: str | None) -> tuple[dict[str, Any] | None, str | None]:
    """A whole text that is one JSON object, or why not: fenced, invalid, not_object."""
    body = (text or "").strip()
    if body.startswith("```"):
        return None, "fenced"
    try:
        value = json.loads(body)
    except ValueError:
        return None, "invalid"
    return (value, None) if isinstance(value, dict) else (None, "not_object")


def lenient_object(text: str | None) -> dict[str, Any] | None:
    """As ``strict_object``, but code fences around are taken off."""
    body = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", (text or "").strip())
    return strict_object(body)[0]


def tool_calls(text: str | None) -> tuple[list[dict[str, Any]], list[str], str]:
    """Calls (name, arguments, block), issues and the text outside blocks."""
    calls, issues, outside, at, blocks = [], [], [], 0, 0
    text = text or ""
    while (start := text.find(_OPEN, at)) >= 0:
        outside.append(text[at:start])
        end = text.find(_CLOSE, start)
        blocks += 1
        if end < 0:
            issues.append("unclosed_tag")
            at = len(text)
            break
        at = end + len(_CLOSE)
        try:
            value = json.loads(text[start + len(_OPEN) : end])
        except ValueError:
            issues.append("invalid_json")
            continue
        if isinstance(value, dict) and isinstance(value.get("name"), str) and value["name"] and isinstance(value.get("arguments"), dict):
            calls.append({"name": value["name"], "arguments": value["arguments"], "block": text[start:at]})
        else:
            issues.append("bad_shape")
    outside.append(text[at:])
    rest = "".join(outside)
    if text.count(_CLOSE) > blocks:
        issues.append("stray_close_tag")
    return calls, issues, rest


def response_calls(text: str | None, api_calls: list[Any] | None = None) -> list[dict[str, Any]]:
    """Name and arguments of the calls of a response: embedded ones, then those given beside the text; arguments that aren't JSON are None."""
    out = [{"name": c["name"], "arguments": c["arguments"]} for c in tool_calls(text)[0]]
    for call in api_calls or []:
        given = call.get("function") if isinstance(call, dict) else None
        given = given if isinstance(given, dict) else {}
        arguments = given.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                arguments = None
        out.append({"name": given.get("name"), "arguments": arguments})
    if not out:
        for body in re.findall(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", text or ""):
            try:
                value = json.loads(body)
            except ValueError:
                value = {}
            if isinstance(value, dict):
                out.append({"name": value.get("name"), "arguments": value.get("arguments")})
    return out


def structured(messages: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The turns, with the calls of an assistant turn as a field of their own where it holds calls and nothing else but white space."""
    out = []
    for m in messages:
        calls, _, rest = tool_calls(m["content"]) if m["role"] == "assistant" else ([], [], "")
        if calls and not rest.strip():
            functions = [{"name": c["name"], "arguments": c["arguments"]} for c in calls]
            out.append({"role": "assistant", "content": None, "tool_calls": [{"type": "function", "function": f} for f in functions]})
        else:
            out.append({"role": m["role"], "content": m["content"]})
    return out


def argument_problems(name: str, arguments: Any) -> list[str]:
    """Why a call doesn't fit the tool registry."""
    if name not in TOOLS:
        return [f"unknown tool {name}"]
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    known = TOOLS[name]
    out = [f"missing {p}" for p, (_, required) in known.items() if required and p not in arguments]
    out += [f"unknown argument {p}" for p in arguments if p not in known]
    return out + [f"{p} is not a {known[p][0]}" for p, v in arguments.items() if p in known and not isinstance(v, _KINDS[known[p][0]])]


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def redacted(value: Any, replace: Any) -> Any:
    """All strings of a JSON value replaced, keys untouched."""
    if isinstance(value, dict):
        return {k: redacted(v, replace) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, replace) for v in value]
    return replace(value) if isinstance(value, str) else value
