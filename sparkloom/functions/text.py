"""Text scalars as Column expressions: normalisation, shingles, similarity, hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.schema import SHINGLE


def normalize(text: Column) -> Column:
    """Stripped, lower case, white space (U+001C to U+001F too) collapsed to one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct character n-grams of normalised text by code point; a shorter text is its own gram, an empty one has none."""
    short = F.when(F.char_length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    fast = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    # the regular expression steps by UTF-16 units, which would cut characters beyond the basic plane
    slow = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.char_length(text) <= n, short).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(fast)


def grams_of(text: str | None) -> np.ndarray:
    """64-bit hashes of ``shingles`` of a normalised text, ascending; null counts as empty."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = min(len(cp), SHINGLE)
    h = np.zeros(len(cp) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = (h ^ cp[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ h >> np.uint64(32)).view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_hashes(texts: pd.Series) -> pd.Series:
    """``grams_of`` by numpy, as SQL functions need a regular expression or a substring from the start for each gram."""
    return pd.Series([grams_of(t) for t in texts], dtype=object)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def json_string(text: Column) -> Column:
    """A JSON string literal with non-ASCII characters as they are and control characters escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    usual = (9, 10, 13)
    for k in usual:
        out = F.replace(out, F.lit(chr(k)), F.lit(named[k]))
    rare = out
    for k in set(range(32)).difference(usual):
        rare = F.replace(rare, F.lit(chr(k)), F.lit(named.get(k, f"\\u{k:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def content_hash(messages: Column, tools: Column | None = None) -> Column:
    """sha256 of the example's canonical JSON (sorted keys, ``", "`` and ``": "``). tools: canonical JSON already, or null."""
    one = lambda m: F.concat(F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}"))
    body = F.concat(F.lit('{"messages": ['), F.array_join(F.transform(messages, one), ", "), F.lit('], "tools": '), F.coalesce(tools if tools is not None else F.lit(None).cast("string"), F.lit("null")), F.lit("}"))
    return F.sha2(body, 256)


def all_text(messages: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), sep)


def template_hash(template: Column) -> Column:
    return F.sha2(template, 256)


def prompt_key(prompt: Column) -> Column:
    """The key of a prompt in a cache of results."""
    return F.substring(F.sha2(prompt, 256), 1, 16)


def tool_call(name: Column, arguments: Column) -> Column:
    """The block of a tool call; arguments: a JSON object as a string."""
    return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))


def md5_bucket(key: Column) -> Column:
    """md5 as a number, modulo 100: folded 32 bits at a time, as 2**32 mod 100 = 96."""
    h = F.md5(key)
    out = F.lit(0).cast("long")
    for k in range(4):
        out = (out * 96 + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")) % 100
    return out


def allowed_path(path: Column) -> Column:
    """Whether a workspace path stays inside and touches no secret file."""
    parts = path.rlike(r"(^|[\\/])\.\.([\\/]|$)") | path.rlike(r"^([\\/]|[A-Za-z]:)")
    secret = F.lower(path).rlike(r"(^|[\\/])(\.env(\.local|\.production|\.development)?|\.git|id_rsa|\.ssh)([\\/]|$)|\.(pem|key|p12|pfx|jks)$")
    return ~(parts | secret)


# Crockford's digits of base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(prefix: str = "ex_") -> Column:
    """A new id: 48 bits of milliseconds and 80 random bits in 26 of Crockford's digits; not deterministic."""
    usual = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of conv
    digits = lambda n, size: F.translate(F.lpad(F.conv(n, 10, 32), size, "0"), usual, CROCKFORD)
    half = lambda: F.floor(F.rand() * F.lit(2.0**40)).cast("long")
    return F.concat(F.lit(prefix), digits(F.unix_millis(F.current_timestamp()), 10), digits(half(), 8), digits(half(), 8))
