"""Licences in texts by sentence rules: normalised sentences become identifiers, whose sequences match ordered rules.

A sentence ends at a full stop, question or exclamation mark or semicolon before white space, or at an empty line; a line
break or colon inside one may be a wrap or an end, so every run of whole lines of a sentence is looked up; where a rule's own
sentence has such an end inside ("v. 2.0."), the run goes on. A rule is an ordered
sequence of identifiers of one licence; it matches where its identifiers follow one another with at most ``GAP`` unknown
sentences between two. Where matches overlap, the one of more identifiers wins, then the earlier rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import chunks

GAP = 1

# Sentences of public licence notices and texts, with their SPDX identifiers; each tuple is one ordered rule.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
)
_GNU_2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
)
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_LGPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
)
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_APACHE_TEXT = (
    "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
)
_GPL_TEXT = (
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
)
_MPL_TEXT = (
    "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "\"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
)
# SPDX identifiers, for rules of the one sentence that names them.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3-only", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
)
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", _MIT), ("MIT", _MIT[:1]), ("MIT", ("Released under the MIT License.",)), ("MIT", ("Licensed under the MIT License.",)), ("MIT", ("This project is licensed under the MIT License.",)), 
    ("BSD-3-Clause", (*_BSD, _BSD_NAME)), ("BSD-2-Clause", _BSD), ("BSD-3-Clause", ("Licensed under the BSD 3-Clause License.",)), ("BSD-2-Clause", ("Licensed under the BSD 2-Clause License.",)),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0 (the \"License\");",)), ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)), 
    ("GPL-3.0-or-later", _GNU), ("GPL-3.0-or-later", _GNU[:1]), ("GPL-3.0-only", ("This work is licensed under the GNU General Public License, version 3.",)), ("GPL-3.0-only", ("Licensed under the GNU General Public License, version 3.",)),
    ("GPL-2.0-only", ("This work is licensed under the GNU General Public License, version 2.",)), ("GPL-2.0-only", ("Licensed under the GNU General Public License, version 2.",)),
    ("LGPL-3.0-only", ("Licensed under the GNU Lesser General Public License, version 3.",)), ("AGPL-3.0-only", ("Licensed under the GNU Affero General Public License, version 3.",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)), ("MPL-2.0", ("Licensed under the Mozilla Public License, version 2.0.",)),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)), ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)), ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.",)), ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0.",)), ("CC-BY-NC-SA-4.0", ("Licensed under CC BY-NC-SA 4.0.",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)), ("CC-BY-SA-4.0", ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",)),
    ("CC0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    ("GPL-2.0-or-later", _GNU_2), ("GPL-2.0-or-later", _GNU_2[:1]), ("LGPL-2.1-or-later", (_LGPL,)), ("LGPL-3.0-or-later", (_LGPL_3,)), ("AGPL-3.0-or-later", (_AGPL,)),
    ("BSD-4-Clause", (*_BSD, _BSD_ADVERTISING, _BSD_NAME)), ("BSD-4-Clause", (*_BSD, _BSD_ADVERTISING)), ("Zlib", _ZLIB), ("Zlib", _ZLIB[2:]), ("BSL-1.0", (_BOOST,)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)), ("Apache-2.0", _APACHE_TEXT), ("GPL-3.0-only", _GPL_TEXT), ("MPL-2.0", _MPL_TEXT),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("EPL-1.0", ("All rights reserved.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html")),
    ("WTFPL", ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)),
    ("OFL-1.1", ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",)), ("Artistic-2.0", ("This is free software, licensed under: The Artistic License 2.0",)),
    ("CC-BY-NC-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",)), ("CC-BY-ND-4.0", ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",)),
    ("CC-BY-NC-SA-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",)), ("CC-BY-NC-ND-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",)),
    *((name, (f"SPDX-License-Identifier: {name}",)) for name in SPDX),
    ("LicenseRef-Proprietary", ("All rights reserved.",)),
)

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n[ \t]*\n\s*")
_LINE = re.compile(r"\n|(?<=:)\s")


def normal(sentence: str) -> str:
    """Lower-case words joined by one space."""
    return " ".join(_WORD.findall(sentence.lower()))


@dataclass(frozen=True)
class Rules:
    ids: dict[str, int]  # normalised sentence -> identifier
    sequences: tuple[tuple[str, tuple[int, ...]], ...]
    openings: frozenset[str]  # first words of the sentences
    longest: int  # words of the longest sentence
    open: frozenset[str]  # normalised beginnings of the sentences up to a place where ``_SENTENCE`` cuts them, as after "v." in "v. 2.0."

    @classmethod
    def of(cls, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Rules:
        ids: dict[str, int] = {}
        sequences = tuple((name, tuple(ids.setdefault(normal(s), len(ids) + 1) for s in parts)) for name, parts in rules)
        cut = frozenset(normal(s[: gap.start()]) for _, parts in rules for s in parts for gap in _SENTENCE.finditer(s))
        return cls(ids, sequences, frozenset(s.split(" ")[0] for s in ids), max((s.count(" ") + 1 for s in ids), default=0), cut)


def sentence_ids(text: str, rules: Rules) -> list[tuple[int, int, int]]:
    """(identifier or 0, start, end) of each sentence in order; a known run of lines splits its sentence, or spans the cuts that its own words have."""
    lines, at = [], 0  # start, end, and the text after it up to the next sentence, None inside a sentence
    for gap in [*_SENTENCE.finditer(text), None]:
        a, end = at, gap.start() if gap else len(text)
        at = gap.end() if gap else at
        for cut in _LINE.finditer(text, a, end):
            lines.append((a, cut.start(), None))
            a = cut.end()
        lines.append((a, end, gap[0] if gap else "\n\n"))
    out: list[tuple[int, int, int]] = []
    k, unknown = 0, False
    while k < len(lines):
        found = None
        word = _WORD.search(text, lines[k][0], lines[k][1])
        if word and word[0].lower() in rules.openings:
            words: list[str] = []
            for j in range(k, len(lines)):
                words += _WORD.findall(text[lines[j][0] : lines[j][1]].lower())
                if len(words) > rules.longest:
                    break
                number = rules.ids.get(" ".join(words))
                if number:
                    found = (number, j)
                if lines[j][2] is not None and (lines[j][2].count("\n") > 1 or " ".join(words) not in rules.open):
                    break
        last = found[1] if found else k
        if found:
            out.append((found[0], lines[k][0], lines[last][1]))
            unknown = False
        elif word and not unknown:
            out.append((0, *lines[k][:2]))
            unknown = True
        if lines[last][2] is not None:
            unknown = False
        k = last + 1
    return out


def matches(found: list[tuple[int, int, int]], rules: Rules) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that match, in text order."""
    known = [(k, x) for k, x in enumerate(found) if x[0]]
    where: dict[int, list[int]] = {}
    for place, (_, (number, _, _)) in enumerate(known):
        where.setdefault(number, []).append(place)
    hits = []
    for order, (name, sequence) in enumerate(rules.sequences):
        for place in where.get(sequence[0], ()):
            end = place
            for want in sequence[1:]:
                nxt = end + 1
                if nxt >= len(known) or known[nxt][1][0] != want or known[nxt][0] - known[end][0] - 1 > GAP:
                    break
                end = nxt
            else:
                hits.append((-len(sequence), order, place, end, name))
    taken: set[int] = set()
    out = []
    for _, _, a, b, name in sorted(hits):
        if taken.isdisjoint(range(a, b + 1)):
            taken.update(range(a, b + 1))
            out.append((name, known[a][1][1], known[b][1][2]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_SPANS = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, *, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, licenses (different ones, sorted, comma-joined), n_licenses, n_sentences (known ones), spans.

    Spans are (license, start, end) in characters, in text order. Null and empty texts, and texts without a known
    sentence, have none. Ids may be null or repeat; other columns aren't read.
    """
    table = Rules.of(rules)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            known, spans = [], []
            for text in batch.column("text").to_pylist():
                found = sentence_ids(text or "", table)
                known.append(sum(1 for x in found if x[0]))
                spans.append([{"license": n, "start": a, "end": b} for n, a, b in matches(found, table)])
            names = [sorted({s["license"] for s in x}) for x in spans]
            columns = [pa.array([",".join(x) for x in names], pa.string()), pa.array([len(x) for x in names], pa.int64()), pa.array(known, pa.int64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "licenses", "n_licenses", "n_sentences", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, licenses string, n_licenses long, n_sentences long, spans array<struct<license:string,start:int,end:int>>").withColumnRenamed("id", id_col)
