"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches after folding homoglyphs and digit substitutions.

The lexicon is learned: whole words and word beginnings whose presence marks toxic texts among labelled rows. Words that
begin like an entry but occur in clean texts become exception phrases, which cancel the hits inside them. The evidence of
a text is the sum of its entries' weights damped by text length; a logistic function maps it to the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import chunks

THRESHOLD = 0.7
#: Labelled rows the lexicon is learned from, at most; taken in the order of a hash of the id.
MAX_TRAIN_ROWS = 8_000
#: Characters of these rows, at most: further rows aren't taken once so many have been read.
MAX_TRAIN_CHARS = 1 << 28
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6, 7)
MIN_DOCS = 3
MIN_LOG_ODDS = 3.0
#: Entries in so large a share of the toxic texts may be less telling.
WIDE, LOW_LOG_ODDS = 0.02, 1.8
#: Decay of the logistic function's two parameters.
RIDGE = 1e-6
#: Evidence that one sure entry gives at any length; more of a long text must be toxic for the rest.
LENGTH_POWER = 0.05

# Letters of other scripts and digits that are written for Latin letters.
_GLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_ZERO_WIDTH = "​‌‍⁠﻿­"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(k): None for k in _ZERO_WIDTH}
    out |= {ord(k): v for k, v in _GLYPHS.items()} | {ord(k.upper()): v for k, v in _GLYPHS.items() if len(k.upper()) == 1}
    out |= {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}  # full-width forms
    out |= {0xFF10 + k: str(k) for k in range(10)}
    return out


_FOLD = _table() | {k: " " for k in (*range(0x80, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2060), *range(0x3000, 0x3004)) if chr(k) not in _ZERO_WIDTH}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_LEET = str.maketrans(_DIGITS)
_SIGN = re.compile(r"[0134578@$!]")
_MIXED = re.compile(r"(?<![^\W_])(?=[\d@$!]*[^\W\d_])[^\W_@$!]*(?:[\d@$!][^\W_]*)+")
#: ASCII bytes that are neither letters nor digits become blanks.
_BLANK = bytes(k if k >= 128 or chr(k).isalnum() else 32 for k in range(256))


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, digits and signs inside words that also have letters as letters, all else that is no letter or digit as blanks."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD)
    if _SIGN.search(text):
        text = _MIXED.sub(_unleet, text)
    return text.encode("utf-8", "replace").translate(_BLANK).decode()


def _unleet(m: re.Match[str]) -> str:
    return m[0].rstrip("!").translate(_LEET)  # closing exclamation marks are just that


@dataclass
class Lexicon:
    """entries: phrase -> weight, exact where it is a whole word; stems: word beginning -> weight; exceptions: words whose stem hits don't count."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: float = 4.0
    bias: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for kind, phrases in (("stem", self.stems), ("word", self.words), ("except", dict.fromkeys(self.exceptions, 0.0))):
            for p, weight in phrases.items():
                found = a.get(" " + p, ()) if (" " + p) in a else ()
                a.add_word(" " + p, (*found, (kind, len(p), weight)))
        if len(a):
            a.make_automaton()
        return a


def evidence(automaton: ahocorasick.Automaton, text: str) -> float:
    """Weight of all entries in the text that no exception covers, damped by the number of words."""
    if not len(automaton) or not text:
        return 0.0
    flat = f" {fold(text)} "
    best: dict[int, tuple[float, int]] = {}
    dead: dict[int, int] = {}
    for end, found in automaton.iter(flat):
        for kind, size, weight in found:
            begin, whole = end - size, flat[end + 1] == " "
            if kind == "except":
                if whole:
                    dead[begin] = max(dead.get(begin, 0), size)
            elif (kind == "stem" or whole) and weight > best.get(begin, (0.0, 0))[0]:
                best[begin] = (weight, size)
    total = sum(weight for begin, (weight, size) in best.items() if dead.get(begin, 0) < size)
    return math.log1p(total / max(1.0, flat.count(" ") - 1) ** LENGTH_POWER)


def learn(rows: Iterable[tuple[str | None, int]], min_docs: int = MIN_DOCS, min_log_odds: float = MIN_LOG_ODDS) -> Lexicon:
    """A lexicon from texts labelled 0 or 1. Without rows of both labels it has no entries."""
    texts: tuple[dict[str, None], dict[str, None]] = ({}, {})
    for text, label in rows:  # copies teach nothing more
        texts[int(bool(label))][fold(text or "")] = None
    n = [len(x) for x in texts]
    lexicon = Lexicon()
    if not n[0] or not n[1]:
        return lexicon
    holders: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, text in enumerate(texts[1]):
        found = set(text.split())
        for key in {(w, 0) for w in found if len(w) > 2} | {(w[:c], 1) for w in found for c in STEMS if len(w) > c}:
            holders[key].append(k)
    need = max(min_docs, n[1] * 0.004)
    holders = {key: x for key, x in holders.items() if len(x) >= need}
    heads = {phrase[: STEMS[0]] for phrase, _ in holders}
    clean: Counter = Counter()
    for text in texts[0]:
        found = {w for w in set(text.split()) if w[: STEMS[0]] in heads}
        clean.update(key for key in {(w, 0) for w in found} | {(w[:c], 1) for w in found for c in STEMS if len(w) > c} if key in holders)
    odds = {key: math.log((len(x) + 0.5) / (n[1] + 1)) - math.log((clean[key] + 0.5) / (n[0] + 1)) for key, x in holders.items()}
    wide = max(min_docs, n[1] * WIDE)
    able = [key for key, x in holders.items() if odds[key] >= (LOW_LOG_ODDS if len(x) >= wide else min_log_odds)]
    # The best entries first, whole words before stems that say the same. An entry of little support must explain texts that
    # no earlier one does: else the other words of a toxic text with many near copies would become entries.
    explained: set[int] = set()
    for phrase, stem in sorted(able, key=lambda x: (-odds[x] * len(holders[x]), x[1], len(x[0]), x[0])):
        new = [k for k in holders[phrase, stem] if k not in explained]
        sure = odds[phrase, stem] >= min_log_odds
        above = max((odds[phrase[:c], 1] for c in STEMS if c <= len(phrase) and phrase[:c] in lexicon.stems), default=None)
        if above is not None and odds[phrase, stem] < above + 1 or stem and any(w.startswith(phrase) for w in lexicon.words):
            continue
        if len(new) >= (need if sure else wide) or sure and len(holders[phrase, stem]) >= wide:
            explained.update(new)
            (lexicon.stems if stem else lexicon.words)[phrase] = odds[phrase, stem]
    toxic = Counter({key: len(x) for key, x in holders.items()})
    clean = Counter()
    for text in texts[0] if lexicon.stems else ():
        clean.update((w, 0) for w in set(text.split()) if any(w[:c] in lexicon.stems for c in STEMS))
    for (phrase, stem), count in clean.items():
        if not stem and any(phrase[:k] in lexicon.stems for k in STEMS) and count > toxic[phrase, 0]:
            lexicon.exceptions.add(phrase)
    a = lexicon.automaton()
    x = np.array([evidence(a, t) for side in texts for t in side])
    y = np.repeat([0.0, 1.0], n)
    top = max(float(np.median(x[(y == 1) & (x > 0)])) if ((y == 1) & (x > 0)).any() else 1.0, 1e-9)
    slope, bias = 1.0, 0.0
    for _ in range(60):  # logistic regression on the scaled evidence by damped Newton steps
        z = x / top
        p = 1 / (1 + np.exp(-(slope * z - bias)))
        g = np.array([np.mean((p - y) * z) + RIDGE * slope, np.mean(y - p) + RIDGE * bias])
        h = p * (1 - p)
        hess = np.array([[np.mean(h * z * z) + RIDGE, -np.mean(h * z)], [-np.mean(h * z), np.mean(h) + RIDGE]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        slope, bias = slope - step[0], bias - step[1]
    lexicon.slope, lexicon.bias = slope / top, bias
    return lexicon


def fit(documents: DataFrame, labels: DataFrame, *, train: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> Lexicon:
    """The lexicon of at most ``max_rows`` labelled rows that satisfy the SQL condition ``train``, the first by a hash of the id.

    An id that repeats is one row, with the highest of its labels and the first of its texts in order. Null ids, and ids
    without a label or a text, teach nothing. Of rows of more than ``max_chars`` characters in all, those that come first
    in the partitions of a shuffle by id are taken.
    """
    known = labels.where(f"{label_col} is not null and {id_col} is not null").where(train).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = documents.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t")).join(F.broadcast(known), id_col)
    rows = rows.groupBy(id_col).agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y")

    def taken() -> Iterator[tuple[str, int]]:
        room = max_chars
        for text, label in rows.toLocalIterator():
            if room <= 0:
                break
            room -= len(text)
            yield text, label

    return learn(taken())


def probability(lexicon: Lexicon, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * x - lexicon.bias, -500, 500)))


def score(documents: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents: id, score in 0..1 and predicted (1 from ``threshold``).

    Null and empty texts have no evidence and get the lowest score. Ids may be null or repeat; other columns aren't read.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in chunks(batches):
            x = np.array([evidence(a, t or "") for t in batch.column("text").to_pylist()])
            s = probability(lexicon, x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(documents: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that ``score`` doesn't predict to be toxic, with all columns, under any names.

    Each row is judged by itself, where it is read, whatever its id: nothing is shuffled. Null and empty texts stay, so do
    repeated rows; an empty table gives an empty result.
    """
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in chunks(batches, place):
            x = np.array([evidence(a, t or "") for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(probability(lexicon, x) < threshold))

    return documents.mapInArrow(run, documents.schema)
