"""Licence scans by conditional compression.

Candidate blocks are the lines that hold a word of licensing or a template's key phrase (which may run over line ends),
joined when at most ``BETWEEN`` other lines lie between them.  Parts of a block around these words, about as long as a
template, are compressed (A-Z in lower case) alone and with the template as a raw zstandard dictionary, for every template,
whatever phrases stand in the block; the greatest relative reductions rank the templates, whatever the length of the block.
Templates that save ``GAIN`` or more are winners and are confirmed, best first, by the exact differences in wording
between template and block: the template's key phrase must stand in the block word for word, and of the template's other
words no more than ``LOST`` may be missing.  SPDX tags are templates too, made by rule for every licence; their
identifiers must stand whole, in any place of an expression (A OR B).

Defined cases: null and empty texts have no blocks; a block may hold several licences, which come by name, and of equal
gains the first template counts; one that another holds whole (``WITHIN``) is left out beside it; a text of any length is
searched as a whole; repeated rows are judged alike; rows without id are kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

BETWEEN = 2
GAIN = 0.15  # least relative reduction of a winner
STEPS = 8  # places of a part within the template's length
LOST = 0.25
CACHE = 20_000

WORDING = r"licen[sc]|copyright|permission|warrant|redistribut|spdx"

# SPDX identifiers, phrases that tell the licence, and wordings of notices in common use.
TEMPLATES = (
    ("Apache-2.0", "apache license version 2 0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache license version 2 0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission is hereby granted free of charge", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD-3-Clause", "neither the name of", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("MIT", "mit license copyright", "MIT License\n\nCopyright (c)"),
    ("BSD-3-Clause", "bsd 3 clause license", "BSD 3-Clause License"),
    ("BSD-2-Clause", "bsd 2 clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "bsd 2 clause license", "BSD 2-Clause License"),
    ("BSD-2-Clause", "redistributions in binary form must reproduce", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "isc license", "Released under the ISC License."),
    ("ISC", "with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "gplv3", "Licensed under the GPLv3."),
    ("GPL-2.0", "gplv2", "Licensed under the GPLv2."),
    ("GPL-2.0", "either version 2 of the license", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general public license version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "gnu lesser general public license version 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general public license version 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "cc by 4 0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "cc0 1 0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "unencumbered software", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "all rights reserved", "Copyright. All rights reserved."),
)

WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}  # whose conditions are among the other's
TAG = "spdx license identifier "
LATER = ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")  # identifiers that come with -only and -or-later, too
TEMPLATES += tuple(
    (name, TAG + identifier, f"SPDX-License-Identifier: {identifier}")
    for name in sorted({name for name, _, _ in TEMPLATES} - {"Proprietary"})
    for identifier in ((name, f"{name}-only", f"{name}-or-later") if name in LATER else (name,))
)

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def phrase(key: str) -> str:
    """Pattern of a key phrase: its words, whatever stands between them."""
    return r"[\W_]+".join(words(key))


def whole(key: str) -> str:
    """The same, but not within longer words; of an SPDX tag: its identifier anywhere in the expression, not within a longer one."""
    if key.startswith(TAG):
        return rf"(?<![^\W_]){phrase(TAG)}[ \t]*:[ \t]*(?:\(?[\w.+-]+\)?[ \t]+(?:and|or|with)[ \t]+)*\(?{re.escape(key[len(TAG):])}(?![.-]?\w)"
    return rf"(?<![^\W_]){phrase(key)}(?![^\W_])"


KEYS = tuple(dict.fromkeys(key for _, key, _ in TEMPLATES if not key.startswith(TAG)))
# MARK finds every text in which _MARK does: Java's \W holds Python's, words need not be whole ones, and a key phrase with a word of licensing in it is found by that.
MARK = "(?i)" + "|".join([WORDING, *(phrase(k) for k in KEYS if not re.search(WORDING, k))])
_MARK = re.compile("(?i)" + "|".join([*map(whole, KEYS), WORDING]))


def blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate block in ``text``."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        last = out[-1][1] if out else 0
        if out and m.end() <= last:
            continue
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        start = text.rfind("\n", last, m.start()) + 1
        if out and (m.start() < last or text.count("\n", last, start) <= BETWEEN + 1):
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


class Scanner:
    def __init__(self, templates=TEMPLATES) -> None:
        import zstandard

        self.templates = [(name, words(text), re.compile("(?i)" + whole(key))) for name, key, text in templates]
        self.sizes = [len(text) for _, _, text in templates]
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = []
        for _, _, text in templates:
            raw = zstandard.ZstdCompressionDict(text.encode().lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=3)
            self.given.append(zstandard.ZstdCompressor(level=3, dict_data=raw))
        self.known: dict[str, list[tuple[str, float]]] = {}

    def saved(self, i: int, part: str, alone: dict[str, int]) -> float:
        """Share of a part, A-Z in lower case, that template ``i`` saves; ``alone`` keeps the sizes without a template."""
        raw = part.encode("utf-8", "surrogatepass").lower()
        if part not in alone:
            alone[part] = len(self.alone.compress(raw))
        return 1 - len(self.given[i].compress(raw)) / alone[part]

    def gain(self, i: int, block: str, marks: list[tuple[int, int]], alone: dict[str, int]) -> float:
        """The greatest share that template ``i`` saves of a part of the block.

        Parts are twice as long as the template and overlap by half; they cover what is no further from any mark than
        the template is long.  Within the best of them parts as long as the template are tried.
        """
        size, near = self.sizes[i], []
        for start, stop in marks or [(0, len(block))]:
            start, stop = max(0, start - size), min(len(block), stop + size)
            if near and start <= near[-1][1]:
                near[-1][1] = stop
            else:
                near.append([start, stop])
        parts = {block[a : min(a + 2 * size, stop)] for start, stop in near for a in range(start, max(start + 1, stop - size), size)}
        best, part = max((self.saved(i, x, alone), x) for x in parts)
        return max([best, *(self.saved(i, part[a : a + size], alone) for a in range(0, len(part) - size + 1, max(1, size // STEPS)))])

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """All templates by the greatest share that they save of a part of the block, best first."""
        marks, alone = [m.span() for m in _MARK.finditer(block)], {}
        return sorted(((self.gain(i, block, marks, alone), i) for i in range(len(self.templates))), key=lambda x: (-x[0], x[1]))

    def confirmed(self, i: int, block: str, found: list[str]) -> bool:
        """Whether the template's key phrase stands in the block, whose words differ from the template's in no more than ``LOST``."""
        _, text, own = self.templates[i]
        if not own.search(block):
            return False
        same = sum(m.size for m in difflib.SequenceMatcher(None, text, found, autojunk=False).get_matching_blocks())
        return same >= (1 - LOST) * len(text)

    def scan(self, block: str) -> list[tuple[str, float]]:
        """Confirmed licences of a block with their gains."""
        if block not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = words(block)
            gains: dict[str, float] = {}
            for gain, i in self.ranked(block):
                if gain < GAIN:
                    break
                name = self.templates[i][0]
                if name not in gains and self.confirmed(i, block, found):
                    gains[name] = gain
            self.known[block] = [(name, gain) for name, gain in gains.items() if WITHIN.get(name) not in gains]
        return self.known[block]


FOUND = "n_blocks long, licenses array<string>, gain double, spans array<struct<start:int,stop:int>>"


def scanner() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for batch in batches:
            count, names, gains, spans = [], [], [], []
            for text in batch["block_text"].to_pylist():
                own = blocks(text) if text is not None else []
                found = [(x, s) for s in own for x in scan.scan(text[s[0] : s[1]])]
                count.append(len(own))
                names.append(sorted({name for (name, _), _ in found}))
                gains.append(max((g for (_, g), _ in found), default=0.0))
                spans.append([{"start": a, "stop": b} for a, b in sorted({s for _, s in found})])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(count, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(gains, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["doc_id", "n_blocks", "licenses", "gain", "spans"],
            )

    return tidy(run)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_blocks, licenses (confirmed, sorted), gain (the best one's), spans of their blocks.

    Texts without any mark aren't sent to Python.
    """
    bounded_batches(docs.sparkSession)
    text = F.when(F.col("text").rlike(MARK), F.col("text"))
    return docs.select("doc_id", text.alias("block_text")).mapInArrow(scanner(), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")
