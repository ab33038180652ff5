"""License scans by conditional compression.

A text is read as words, whatever its lines. Around each word that licence notices use (a cue), as many words as the template may take stand on either
side in question: over line ends, comment marks and blank lines. Those are compared word by word: a winner must hold the cue and the template's words
in order, but for a share of at most MISSING, and none of the words that tell licences apart (numbers, versions, clauses) may be missing or different. The
winner's lines must be compressed better by zstandard with the template as raw dictionary than alone; of several winners the one with most words in common
is taken. Its words are then taken out, and what is left is scanned until no template is confirmed.

Nulls: null texts and ids of null are scanned as empty and reported with a null id. Rows that repeat are reported each. Other columns don't matter.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import slices

CUE = r"(?i)licen[cs]|copyright|\(c\)|©|all\s+rights\s+reserved|public\s+domain|warrant|redistribut|permission|spdx|creative\s+commons|cc0|\bcc[\s-]+by"
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-Rights-Reserved": "All rights reserved.",
}
#: Words by which licences of like wording differ.
TELLING = re.compile(r"\d|^(?:by|nc|sa|nd|by-nc|by-sa|by-nd|by-nc-sa|by-nc-nd|lesser|affero|library|mit|apache|gnu|mozilla|cc0|not|all|rights|reserved)$")
MISSING = 0.2
WORD = re.compile(r"\w+(?:[.-]\w+)*")


def wording(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {k: wording(t) for k, t in templates.items()}
        self.reach = int(max((len(w) for w in self.words.values()), default=0) * (1 + MISSING)) + 2
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.given = {k: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, t in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.telling = {k: Counter(x for x in w if TELLING.search(x)) for k, w in self.words.items()}

    def saved(self, text: str, template: str) -> int:
        raw = text.encode()
        return len(self.plain.compress(raw)) - len(self.given[template].compress(raw))

    def differences(self, has: list[str], template: str) -> tuple[list[int], list[str], list[str], bool] | None:
        """(places of has that the template shares, the template's words that are missing, those of has between its first and last shared word that are added,
        confirmed), of the run of shared pieces with the fewest differences. None if too few words can be shared."""
        own = self.words[template]
        seen = Counter(has)
        if any(seen[w] < n for w, n in self.telling[template].items()) or sum(min(n, seen[w]) for w, n in self.counts[template].items()) < (1 - MISSING) * len(own):
            return None
        same = [m for m in difflib.SequenceMatcher(None, own, has, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(same)):
            size = 0
            for j in range(i, len(same)):
                size += same[j].size
                cost = len(own) - size + same[j].b + same[j].size - same[i].b - size
                if best is None or cost < best[0]:
                    best = cost, same[i : j + 1]
        kept = {i for m in best[1] for i in range(m.a, m.a + m.size)}
        used = [i for m in best[1] for i in range(m.b, m.b + m.size)]
        missing = [w for i, w in enumerate(own) if i not in kept]
        added = [has[i] for i in sorted(set(range(used[0], used[-1] + 1)).difference(used))]
        telling = any(TELLING.search(w) for w in [*missing, *added])
        return used, missing, added, not telling and len(missing) <= MISSING * len(own) and len(added) <= MISSING * len(own) + 2

    def at_cue(self, has: list[str], cue: int, template: str) -> tuple[list[int], list[str], list[str]] | None:
        """The template's confirmed places around the word `cue`: like words beside it are cut off until they hold it, or too few are left."""
        reach = int(len(self.words[template]) * (1 + MISSING)) + 2
        lo, hi = max(0, cue - reach), min(len(has), cue + reach + 1)
        while found := self.differences(has[lo:hi], template):
            used, missing, added, ok = found
            first, last = lo + used[0], lo + used[-1]
            if first <= cue <= last:
                return ([lo + i for i in used], missing, added) if ok else None
            lo, hi = (last + 1, hi) if last < cue else (lo, first)
        return None

    def found(self, text: str) -> list[tuple[int, int, str, int, list[str], list[str]]]:
        """(line, lines, template, bytes saved, missing, added) of all notices of a text."""
        spans = [m.span() for m in WORD.finditer(text)]
        ends, words_ = [e for _, e in spans], [text[s:e].lower() for s, e in spans]
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        cues = sorted({c for m in re.finditer(CUE, text) if (c := bisect_right(ends, m.start())) < len(spans)})
        left, out = list(range(len(spans))), []  # the words that no notice has taken
        for cue in cues:
            while True:
                at = bisect_right(left, cue) - 1
                if at < 0 or left[at] != cue:
                    break
                lo = max(0, at - self.reach)
                near, winners = left[lo : at + self.reach + 1], []
                for k in self.templates:
                    if won := self.at_cue([words_[i] for i in near], at - lo, k):
                        used, missing, added = won
                        first, last = near[used[0]], near[used[-1]]
                        line, end = bisect_right(breaks, spans[first][0]), bisect_right(breaks, spans[last][0])
                        lines = text[breaks[line - 1] + 1 if line else 0 : breaks[end] if end < len(breaks) else len(text)]
                        if (saved := self.saved(lines, k)) > 0:
                            winners.append((2 * len(missing) + len(added) - len(self.words[k]), -saved, k, line, end - line + 1, missing, added, used))
                if not winners:
                    break
                _, saved, k, line, n, missing, added, used = min(winners)
                out.append((line, n, k, -saved, missing, added))
                taken = {near[i] for i in used}
                left = [*left[:lo], *(i for i in near if i not in taken), *left[at + self.reach + 1 :]]
        return sorted(out)


def scanning(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for b in slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            ids = b.column("doc_id")
            out = [(ids[r].as_py(), *x) for r in pc.indices_nonzero(pc.match_substring_regex(texts, CUE)).to_pylist() for x in known.found(texts[r].as_py())]
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "line_no", "n_lines", "license", "bytes_saved", "missing", "added"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licence notices of docs(doc_id, text): (doc_id, line_no from 0, n_lines, license, bytes_saved, missing, added)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scanning(templates), "doc_id long, line_no int, n_lines int, license string, bytes_saved int, missing array<string>, added array<string>")
