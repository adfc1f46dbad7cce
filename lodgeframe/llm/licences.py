"""Licence scan: known sentences, then ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers of licence sentences and their wording (any case and punctuation).
SENTENCES = {
    "reserved": ["All rights reserved."],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "This project is licensed under the Apache License, Version 2.0.",
    ],
    "apache-compliance": [
        "you may not use this file except in compliance with the License.",
    ],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": [
        'Unless required by applicable law or agreed to in writing, software distributed under the '
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
    ],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this '
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "gpl-2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version."
    ],
    "lgpl-3-free": [
        "This library is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ],
    "lgpl-2.1-free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version."
    ],
    "agpl-3-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
    ],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ],
    "gpl-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": ["This work is dedicated to the public domain.", "Licensed under CC0 1.0."],
}

#: Sentences with a name in the middle, by what stands before and behind it.
NAMED_SENTENCES = {
    "bsd-names": (
        "Neither the name of",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
}

#: What a tag names, where no rule below has the name already.
TAG = "SPDX-License-Identifier"
TAGGED = ["BSD-3-Clause", "0BSD", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "BSL-1.0", "EPL-2.0", "Zlib"]

#: Licences and the sequences of sentences that state them.
RULES = [
    ("Apache-2.0", ["apache-2", "apache-compliance", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-2", "apache-compliance"]),
    ("Apache-2.0", ["apache-2"]),
    ("MIT", ["mit", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free"]),
    ("AGPL-3.0-or-later", ["agpl-3-free", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-3-free"]),
    ("MPL-2.0", ["mpl-2"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0-only", ["gpl-3"]),
    ("GPL-2.0-only", ["gpl-2"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
TAG_RULES = [(name, [f"tag:{name}"]) for name in dict.fromkeys([*(n for n, _ in RULES), *TAGGED])]
TAG_NAMES = {name.lower(): name for name, _ in TAG_RULES}
#: Lines that a sentence with a name may be wrapped over.
MOST_LINES = 8

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: A sentence ends at a line break, or at a stop, colon or semicolon (with closing marks) before white space.
#: Lines of one sentence in a wrapped notice are joined again by word wrapping below.
SENTENCE_END = re.compile(r"(?<=[.!?:;])[\"')\]]*\s+|\n+")


def normalised(sentence: str) -> str:
    return " ".join(WORD.findall(sentence.lower()))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Offsets in characters of each sentence."""
    at = 0
    for end in SENTENCE_END.finditer(text):
        if end.start() > at:
            yield at, end.start()
        at = end.end()
    if at < len(text):
        yield at, len(text)


def identified(text: str, known: dict[str, str], heads: dict[str, set[str]]) -> list[tuple[str, int, int]]:
    """Known sentences in order: identifier, start, stop. A sentence may be wrapped over several lines."""
    found = []
    spans = list(sentences(text))
    at = 0
    while at < len(spans):
        a, b = spans[at]
        piece = normalised(text[a:b])
        took = 1
        if piece not in known and piece in heads:
            whole = piece
            for more in range(at + 1, len(spans)):
                whole = f"{whole} {normalised(text[spans[more][0] : spans[more][1]])}"
                if not any(k.startswith(whole) for k in heads[piece]):
                    break
                if whole in heads[piece]:
                    piece, b, took = whole, spans[more][1], more - at + 1
                    break
        if piece in known:
            found.append((known[piece], a, b))
        elif piece == TAG.lower() and at + 1 < len(spans):
            # the tag's colon ends a sentence; the name is the first word of the next one
            c, d = spans[at + 1]
            word = text[c:d].split()[:1]
            name = TAG_NAMES.get(word[0].lower()) if word else None
            if name is not None:
                found.append((f"tag:{name}", a, text.index(word[0], c) + len(word[0])))
                took = 2
        else:
            for name, (before, behind) in NAMED_SENTENCES.items():
                if not piece.startswith(normalised(before)):
                    continue
                whole = piece
                for more in range(at, min(at + MOST_LINES, len(spans))):
                    whole = whole if more == at else f"{whole} {normalised(text[spans[more][0] : spans[more][1]])}"
                    if whole.endswith(normalised(behind)):
                        found.append((name, a, spans[more][1]))
                        took = more - at + 1
                        break
        at += took
    return found


def matched(
    found: list[tuple[str, int, int]], rules: list[tuple[str, list[str]]], gap: int
) -> list[tuple[str, int, int]]:
    """Rules in order of the text, each sentence used once: at each place the longest rule that fits,
    the earlier listed of equally long ones. Sentences of a rule may be at most ``gap`` characters apart."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    hits, at = [], 0
    while at < len(found):
        for name, wanted in ordered:
            part = found[at : at + len(wanted)]
            near = all(y[1] - x[2] <= gap for x, y in zip(part, part[1:]))
            if [x[0] for x in part] == wanted and near:
                hits.append((name, part[0][1], part[-1][2]))
                at += len(wanted)
                break
        else:
            at += 1
    return hits


def _scan(table: dict[str, list[str]], rules: list[tuple[str, list[str]]], gap: int):
    known = {normalised(s): name for name, wordings in table.items() for s in wordings}
    heads: dict[str, set[str]] = {}
    for sentence in known:
        words = sentence.split()
        for n in range(1, len(words)):
            heads.setdefault(" ".join(words[:n]), set()).add(sentence)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits = [], []
            for text in batch.column("text").to_pylist():
                seen = identified(text or "", known, heads)
                ids.append([s[0] for s in seen])
                hits.append(
                    [{"licence": n, "start": a, "stop": b} for n, a, b in matched(seen, rules, gap)]
                )
            hit = pa.struct([("licence", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.string())), pa.array(hits, pa.list_(hit))],
                names=["doc_id", "sentence_ids", "hits"],
            )

    return emit


def scan_licences(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    table: dict[str, list[str]] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
    gap: int = 400,
) -> DataFrame:
    """``doc_id``, ``sentence_ids`` and ``hits`` (array of licence, start, stop) of every row.

    Sentences are compared without case, punctuation and spacing; an SPDX tag with a known name is a sentence too. ``hits`` are in order of the
    text, with offsets in characters; a sentence that no rule uses is in ``sentence_ids`` only. A missing or empty
    text has empty arrays, repeated rows have equal results, a missing id stays missing. Other columns are ignored. Rows
    are treated where they lie: no shuffle.
    """
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).mapInArrow(
        _scan(table or SENTENCES, [*(rules or RULES), *TAG_RULES], gap),
        "doc_id long, sentence_ids array<string>, "
        "hits array<struct<licence: string, start: int, stop: int>>",
    )
