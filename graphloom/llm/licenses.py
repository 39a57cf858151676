"""Licence notices found by exact wording around each cue and by conditional compression.

A word that speaks of licensing is a cue. Around each cue, each template has a window of twice its words on both sides, within
the same paragraph's lines. The templates whose words the window has in sufficient number are candidates, ranked by the bytes that
zstandard saves on the window with the template as a raw dictionary. In that order, without a limit, exact wording decides: the words
of the template that the window lacks, and the words in between, are counted by matching blocks, and the first template of which few
enough are missing, with the cue in the notice, is the winner. The search goes on after its last word.

Defined results: null and empty texts have no notices; rows come back one for one; other columns are
ignored. Positions are code points of the notice with the punctuation that follows it, ends exclusive.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from .common import id_and_text, session_of, small_batches

# Short notices and openings of common licences.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}

_CUE = re.compile(r"licen[sc]e|copyright|all\s+rights\s+reserved|redistribut|permission\s+is\s+hereby|public\s+domain|creative\s+commons|spdx", re.I | re.A)
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
_TAIL = re.compile(r"[^\w\s]*")


@dataclass(frozen=True)
class Settings:
    least_share: float = 0.85  # of the template's words that the notice has, in order
    level: int = 3


SETTINGS = Settings()


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """The runs of lines between empty ones."""
    start = last = None
    for m in _LINE.finditer(text):
        a, b = m.span()
        if start is not None and a != last + 1:
            yield start, last
            start = None
        start, last = a if start is None else start, b
    if start is not None:
        yield start, last


class Matcher:
    def __init__(self, templates: dict[str, str] = TEMPLATES, settings: Settings = SETTINGS):
        import zstandard as z

        self.settings = settings
        self.plain = z.ZstdCompressor(level=settings.level, write_content_size=False, write_checksum=False).compress
        self.names = list(templates)
        self.words = [words(t) for t in templates.values()]
        self.bags = [Counter(w) for w in self.words]
        self.given = [z.ZstdCompressor(level=settings.level, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress for t in templates.values()]

    def saving(self, notice: bytes, template: int) -> int:
        """Bytes of a window that the template as a dictionary saves."""
        return len(self.plain(notice)) - len(self.given[template](notice))

    def confirm(self, block: list[str], template: int) -> tuple[int, int, int, int] | None:
        """Words of the template that the block lacks, words of the block within what matches, and where that is."""
        m = SequenceMatcher(None, self.words[template], block, autojunk=False).get_matching_blocks()[:-1]
        # an outer match that is farther off than it is long is a word of the prose
        while len(m) > 1 and m[1].b - m[0].b - (m[1].a - m[0].a) > m[0].size:
            m = m[1:]
        while len(m) > 1 and (m[-1].b - m[-2].b - m[-2].size) - (m[-1].a - m[-2].a - m[-2].size) > m[-1].size:
            m = m[:-1]
        if not m:
            return None
        same, start, end = sum(x.size for x in m), m[0].b, m[-1].b + m[-1].size
        return len(self.words[template]) - same, end - start - same, start, end

    def best(self, text: str, found: list[tuple[int, int]], own: list[str], cue: int, first: int) -> dict | None:
        """The notice around the word `cue`, from the word `first` on: of the candidate templates, ranked by the bytes that each saves on its
        window, the first whose wording is confirmed. found: the words' positions."""
        ranked = []
        for k, want in enumerate(self.words):
            low = max(first, cue - 2 * len(want))
            block = own[low : cue + 2 * len(want) + 1]
            if (Counter(block) & self.bags[k]).total() >= self.settings.least_share * len(want):
                window = text[found[low][0] : found[low + len(block) - 1][1]]
                ranked.append((-self.saving(window.encode(), k), k, low, block))
        for saved, k, low, block in sorted(ranked, key=lambda r: r[:2]):
            n = len(self.words[k])
            if (got := self.confirm(block, k)) is None:
                continue
            missing, more, a, b = got
            if n - missing >= self.settings.least_share * n and more <= n and low + a <= cue < low + b:
                start, end = found[low + a][0], _TAIL.match(text, found[low + b - 1][1]).end()
                return {"licence": self.names[k], "start": start, "end": end, "saving": -saved, "missing": missing, "more": more}
        return None

    def notices(self, text: str | None) -> list[dict]:
        """The notices of a text, one after the other: what lies in one begins no other."""
        out: list[dict] = []
        if not text or not _CUE.search(text):
            return out
        for a, b in paragraphs(text):
            at, first, found = a, 0, None
            while cue := _CUE.search(text, at, b):
                if found is None:
                    found = [m.span() for m in _WORD.finditer(text, a, b)]
                    own = [text[x:y].lower() for x, y in found]
                    ends = [y for _, y in found]
                at = cue.end()
                if (got := self.best(text, found, own, bisect_right(ends, cue.start()), first)) is not None:
                    out.append(got)
                    at = max(at, got["end"])
                    first = bisect_right(ends, got["end"])
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, notices array<struct<licence, start, end, saving, missing, more>> by start. Templates are a parameter, so of bounded size."""
    small_batches(session_of(docs))
    known = dict(templates or TEMPLATES)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saving", pa.int32()), ("missing", pa.int32()), ("more", pa.int32())]))
        own = Matcher(known, settings)
        for b in batches:
            out = [own.notices(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "notices"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, notices array<struct<licence:string,start:int,end:int,saving:int,missing:int,more:int>>")
