"""Rendered examples and their length in tokens."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.chat_json import structured

#: Characters of texts that are encoded at once, at most, unless one text has more.
BATCH_CHARS = 1 << 18


def rendered_pieces(messages: Column, tools: Column) -> Column:
    """``rendered`` in pieces: the tools, then each turn."""
    return F.concat(F.array(F.coalesce(tools, F.lit(""))), F.transform(messages, lambda m: rendered(F.array(m))))


def rendered(messages: Column, tools: Column | None = None) -> Column:
    """ChatML of all turns, after the tools if there are any; what else a model's own template adds isn't in it."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    body = F.array_join(F.transform(messages, turn), "")
    return body if tools is None else F.concat(F.coalesce(tools, F.lit("")), body)


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lengths(texts: Iterable[str | None], path: str) -> Iterator[int]:
    """Tokens of each text. A token takes some hundred bytes while it is encoded, so BATCH_CHARS of texts are at a time, or one text."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > BATCH_CHARS:
            yield from (len(e) for e in _tokenizer(path).encode_batch_fast(some, add_special_tokens=False))
            some, size = [], 0
        some.append(t or "")
        size += len(t or "")
    yield from (len(e) for e in _tokenizer(path).encode_batch_fast(some, add_special_tokens=False))


def token_count(text: Column, path: str) -> Column:
    """Tokens of whole texts by the tokenizer file at path, which every executor must have; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else n for t, n in zip(texts, _lengths(texts, path), strict=True)], dtype="Int64")

    return count(text)


def piece_ends(pieces: Column, path: str | None = None) -> Column:
    """For each piece of a text, the tokens (of the tokenizer file at path; characters without one) that end with it or before.

    The joined text is encoded once, and places of pieces are looked up among the ends of its tokens; null for null.
    """

    def ends(texts: list[str]) -> list[int]:
        places = np.cumsum([len(x) for x in texts])
        if path is None:
            return places.tolist()
        tokens = _tokenizer(path).encode("".join(texts), add_special_tokens=False).offsets
        return np.searchsorted(np.array([b for _, b in tokens], np.int64), places, "right").tolist()

    @F.pandas_udf("array<long>")
    def counted(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else ends(list(x)))

    return counted(pieces)


@F.pandas_udf(T.StringType())
def structured_messages(messages: pd.Series) -> pd.Series:
    """The turns as a JSON list with tool calls as fields; null for null."""
    return messages.map(lambda x: None if x is None else json.dumps(structured(list(x)), ensure_ascii=False))
