"""License scans by conditional compression.

Lines with license vocabulary and those around them form blocks, and blocks are cut into overlapping windows of about twice
the longest template. Each window is compressed with zstandard, once alone and once with each template as a raw
dictionary, and the templates are ranked by how much they reduce its size. Down the ranking, a winner is confirmed by
exact wording: a match holds most of the template's words in order, close together, and all of its deciding words (names,
versions, clauses); what is missing or added is reported. The ranking ends when every place with vocabulary belongs to a
match without differences. Of overlapping matches those stay that together save most bytes, less the bytes that differ. Windows are as long as templates,
so the length of a block or line cannot hide a notice.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = r"(?i)licen[cs]e|copyright|permission is hereby|redistribut|warrant|spdx|all rights reserved|public domain|creative commons|\bCC (?:BY|0)"
#: Characters around a place with vocabulary that belong to its block, up to whole lines.
MARGIN = 1500
SHARE = 0.85
#: Characters around a match that are compressed with it.
AROUND = 20


@dataclass(frozen=True)
class Template:
    """A notice, and the words that decide which license it is."""

    license: str
    text: str
    deciding: tuple[str, ...]


_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Wordings of public notices, and whole texts of short licenses.
TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "Licensed under the MIT License.", ("mit",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby", "sublicense", "sell")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache", "2.0", "compliance")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "3", "redistribute")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("sublicense", "noninfringement", "tort")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("fee", "purpose", "disclaims")),
    Template("BSD", _BSD_1, ("redistribution", "binary", "permitted")),
    Template("BSD-2-Clause", _BSD_1 + _BSD_2 + _BSD_END, ("retain", "reproduce", "disclaimed")),
    Template("BSD-3-Clause", _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END, ("endorse", "retain", "reproduce", "disclaimed")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC0-1.0", "Licensed under CC0 1.0.", ("cc0", "1.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "attribution", "4.0")),
    Template("proprietary", "All rights reserved.", ("rights", "reserved")),
)
_WORD = re.compile(r"[\w][\w.+-]*")


def wording(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words without marks at their ends, with their places."""
    return [(m.group().rstrip(".-").lower(), m.start(), m.start() + len(m.group().rstrip(".-"))) for m in _WORD.finditer(text)]


class Scanner:
    """Compressors for all templates, and the blocks and windows of one text."""

    def __init__(self, templates: tuple[Template, ...], level: int = 3):
        import zstandard as z

        self.templates = templates
        self.words = [[w for w, _, _ in wording(t.text)] for t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.spots = [[i for i, w in enumerate(words) if w == t.deciding[0]] for t, words in zip(templates, self.words, strict=True)]
        self.reach = 2 * max(map(len, self.words))
        self.plain = z.ZstdCompressor(level=level, write_content_size=False)
        self.primed = [z.ZstdCompressor(level=level, write_content_size=False, dict_data=z.ZstdCompressionDict(t.text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for t in templates]
        self.vocabulary = re.compile(VOCABULARY)

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """Start and text of each run of lines that come within MARGIN characters of vocabulary."""
        begin, until = -1, -1
        for hit in self.vocabulary.finditer(text):
            if begin < 0 or hit.start() - MARGIN > until:
                if begin >= 0:
                    yield begin, text[begin:until]
                begin = max(until, text.rfind("\n", max(until, 0), max(0, hit.start() - MARGIN)) + 1)
            if hit.end() + MARGIN > until:
                until = text.find("\n", min(hit.end() + MARGIN, len(text)))
                until = len(text) if until < 0 else until
        if begin >= 0:
            yield begin, text[begin:until]

    def windows(self, words: list[tuple[str, int, int]], hits: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """First and last word of windows that overlap by half, with the vocabulary places in each; only those that have some."""
        half = self.reach // 2
        for a in range(0, max(len(words) - half, 1), half):
            b = min(a + self.reach, len(words))
            inside = hits[bisect_left(hits, words[a][1]) : bisect_left(hits, words[b - 1][2])]
            if inside:
                yield a, b, inside

    def saved(self, place: str, k: int) -> tuple[int, float]:
        """Bytes that a place saves with the template as dictionary, and what share of its size that is."""
        raw = place.encode()
        alone = len(self.plain.compress(raw))
        less = alone - len(self.primed[k].compress(raw))
        return less, round(less / alone, 6)

    def rate(self, block: str, s: int, e: int, k: int, differences: tuple[list[str], list[str]]) -> tuple[int, float]:
        """Bytes that the place saves, less the bytes in which its wording differs; 1 at least. And the share that is saved."""
        less, share = self.saved(block[max(0, s - AROUND) : e + AROUND], k)
        return max(less - sum(len(w) + 1 for part in differences for w in part), 1), share

    @staticmethod
    def best(matches: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of matches (start, end, template, bytes, share) those that do not overlap and have most bytes together; on ties the
        earlier ends and templates."""
        rows = sorted(matches, key=lambda m: (m[1], m[0], m[2]))
        ends = [m[1] for m in rows]
        total, taken = [0] * (len(rows) + 1), [0] * len(rows)
        for i, m in enumerate(rows):
            before = bisect_right(ends, m[0], 0, i)
            total[i + 1], taken[i] = total[i], -1
            if total[before] + m[3] > total[i]:
                total[i + 1], taken[i] = total[before] + m[3], before
        out, i = [], len(rows)
        while i:
            if taken[i - 1] < 0:
                i -= 1
            else:
                s, e, k, _, share = rows[i - 1]
                out.append((s, e, k, share))
                i = taken[i - 1]
        return out

    def ranked(self, window: str) -> list[int]:
        """Templates by the size that they save, the largest saving first; ties go to the earlier template."""
        raw = window.encode()
        return sorted(range(len(self.templates)), key=lambda k: (len(self.primed[k].compress(raw)), k))

    def about(self, have: list[str], k: int, i: int, least: int, most: int) -> tuple[int, int, list[str], list[str]] | None:
        """The template's wording with word i of a block, one of its first deciding words, in its place: first and last word,
        words missing, words added. Only the words from `least` to before `most` are used.

        What lies before and after the word is compared apart, from the word outwards, so that of equal notices in a row each
        word finds its own.
        """
        want = self.words[k]
        n, best = len(want), None
        for p in self.spots[k]:
            slack = n // 2 + 3
            before, after = have[max(least, i - p - slack) : i][::-1], have[i + 1 : min(most, i + n - p + slack)]
            if (Counter(before + after + [want[p]]) & self.counts[k]).total() < SHARE * n:
                continue
            left, right = (SequenceMatcher(None, w, h, autojunk=False).get_matching_blocks()[:-1] for w, h in ((want[:p][::-1], before), (want[p + 1 :], after)))
            kept = {p} | {p - 1 - m.a - x for m in left for x in range(m.size)} | {p + 1 + m.a + x for m in right for x in range(m.size)}
            used = {i} | {i - 1 - m.b - x for m in left for x in range(m.size)} | {i + 1 + m.b + x for m in right for x in range(m.size)}
            first, last = min(used), max(used) + 1
            if len(kept) >= SHARE * n and last - first <= 1.5 * n + 3 and {want[x] for x in kept}.issuperset(self.templates[k].deciding) and (best is None or len(kept) > best[0]):
                best = len(kept), (first, last, [w for x, w in enumerate(want) if x not in kept], [have[x] for x in range(first, last) if x not in used])
        return best and best[1]

    def confirm(self, have: list[str], places: dict[str, list[int]], k: int, a: int, b: int) -> list[tuple[int, int, list[str], list[str]]]:
        """Where the template's wording stands about the words a..b of a block, none overlapping; each match covers the word
        that it was looked for at. Equal wording goes first, and what differs is looked for between. places: where each word
        stands in the block."""
        want, found, open_ = self.words[k], [], []
        anchors = places.get(self.templates[k].deciding[0], [])
        at = 0
        for i in anchors[bisect_left(anchors, a) : bisect_left(anchors, b)]:
            start = next((i - p for p in self.spots[k] if i - p >= at and have[i - p : i - p + len(want)] == want), -1)
            if start >= 0:
                at = start + len(want)
                found.append((start, at, [], []))
            elif i >= at:
                open_.append(i)
        equal, at, j = list(found), 0, 0
        for i in open_:
            while j < len(equal) and equal[j][0] <= i:
                at = max(at, equal[j][1])
                j += 1
            other = self.about(have, k, i, at, equal[j][0] if j < len(equal) else len(have)) if i >= at else None
            if other:
                found.append(other)
                at = other[1]
        return found

    def scan(self, text: str) -> list[dict]:
        out: list[dict] = []
        for begin, block in self.blocks(text):
            words, hits = wording(block), [m.start() for m in self.vocabulary.finditer(block)]
            matches: dict[tuple[int, int, int], tuple] = {}
            have, places = [w for w, _, _ in words], defaultdict(list)
            for i, w in enumerate(have):
                places[w].append(i)
            for a, b, inside in self.windows(words, hits):
                open_ = set(inside)
                for k in self.ranked(block[words[a][1] : words[b - 1][2]]):
                    for first, last, missing, added in self.confirm(have, places, k, a, b):
                        s, e = words[first][1], words[last - 1][2]
                        matches.setdefault((s, e, k), (missing, added))
                        if not missing and not added:  # no other template can explain this place better
                            open_ -= {h for h in inside if s <= h < e}
                    if not open_:
                        break
            for s, e, k, saved in self.best([(s, e, k, *self.rate(block, s, e, k, d)) for (s, e, k), d in matches.items()]):
                missing, added = matches[s, e, k]
                out.append({"license": self.templates[k].license, "start": begin + s, "end": begin + e, "saved": saved, "missing": missing, "added": added})
        return sorted(out, key=lambda x: (x["start"], x["end"]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, found: array<struct<license, start, end, saved, missing, added>>, code points; one row per input row.

    Null, empty or plain texts have an empty list; they are told apart by one expression before any text leaves the JVM.
    Null ids stay null; rows do not affect each other, so repeats do not matter. Of overlapping matches those stay that together
    save most, less what differs; ties go to the earlier place and template. The work on a long text is in proportion to its windows. An
    empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    hit = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, hit)], ["doc_id", "found"])

    t = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(t.rlike(VOCABULARY), t).alias("t"))
    return source.mapInArrow(run, f"doc_id {kind}, found array<struct<license:string,start:int,end:int,saved:double,missing:array<string>,added:array<string>>>")


def digest(found: DataFrame) -> DataFrame:
    """Per document: number of notices, licenses in order of place, and license:start:end of each."""
    one = lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_notices"), F.array_join(F.array_distinct(F.transform("found", lambda x: x["license"])), ",").alias("licenses"), F.array_join(F.transform("found", one), ",").alias("spans"))
