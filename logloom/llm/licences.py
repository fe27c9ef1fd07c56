"""Licence scans with a generalised suffix automaton over the words of licence texts.

One automaton holds every part of every template. A file's words are streamed through it: at each word the longest stretch
that ends there and occurs in some template is known (matching statistics). Stretches of MIN_MATCH words or more are chained
while gaps stay small and the template goes on, at the next of all the places where it has the stretch; a chain that covers enough of a template, or enough words, gives its label.
Words outside all templates reset the automaton, so only runs of template words are streamed, with the same result.

Base phrases are found wherever their words stand consecutively and always give their labels. Null and empty texts have no words
and no labels; repeated rows are scanned each for itself; an empty table gives no rows. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER_ALNUM, kind, map_batches, table, texts, utf8, words

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label -> texts of licences, their notices and statements.
TEMPLATES = {
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "gpl": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "agpl": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "reserved": ["Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
}
#: Shortest stretch that counts; words without a match between two stretches of a chain; words that suffice; share of a template that suffices.
MIN_MATCH, MAX_GAP, ENOUGH_WORDS, ENOUGH_SHARE = 3, 8, 12, 0.8


class Automaton:
    """A generalised suffix automaton over words. ends: for each state and template, all places where the stretch ends in it, in order."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [{}]
        for k, text in enumerate(texts):
            last = 0
            for i, word in enumerate(text):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, set()).add(i)
        for state in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[state]:  # the empty stretch ends everywhere
                for k, places in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(k, set()).update(places)
            self.ends[state] = {k: sorted(places) for k, places in self.ends[state].items()}

    def _add(self, length: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.len.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = self._add(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, word: bytes) -> int:
        if word in self.next[p]:
            q = self.next[p][word]
            return q if self.len[q] == self.len[p] + 1 else self._split(p, q, word)
        new = self._add(self.len[p] + 1, {}, 0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, word)
        return new

    def stretches(self, text: list[bytes], start: int, stop: int, least: int) -> Iterator[tuple[int, int, dict[int, list[int]]]]:
        """(first word, end, ends) of the stretches of text[start:stop] that no longer one holds."""
        state, n = 0, 0
        for i in range(start, stop):
            after = self.next[state].get(text[i])
            if after is None:
                if n >= least:
                    yield i - n, i, self.ends[state]
                while after is None and state:
                    state = self.link[state]
                    n = self.len[state]
                    after = self.next[state].get(text[i])
            if after is None:
                n = 0
            else:
                state, n = after, n + 1
        if n >= least:
            yield stop - n, stop, self.ends[state]


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.parts = [(label, words(t, LOWER_ALNUM)) for label, parts in templates.items() for t in parts]
        self.automaton = Automaton([t for _, t in self.parts])
        self.phrases = [(tuple(words(p, LOWER_ALNUM)), label) for p, label in phrases.items()]
        self.vocabulary = frozenset(w for _, t in self.parts for w in t) | frozenset(w for p, _ in self.phrases for w in p)
        self.runs = re.compile(b"\x01{%d,}" % min(MIN_MATCH, *(len(p) for p, _ in self.phrases)))

    def scan(self, text: str | None) -> dict:
        """n_words, places (first words of base phrases, with labels), found: label -> (share of its template covered, spans of words)."""
        w = words(text, LOWER_ALNUM)
        marks = bytes(map(self.vocabulary.__contains__, w))
        places: list[tuple[int, str]] = []
        chains: dict[int, list] = {}
        found: dict[str, tuple[float, list[tuple[int, int]]]] = {}
        for run in self.runs.finditer(marks):
            for i in range(run.start(), run.end()):
                for phrase, label in self.phrases:
                    if w[i] == phrase[0] and tuple(w[i : i + len(phrase)]) == phrase:
                        places.append((i, label))
            for a, b, ends in self.automaton.stretches(w, run.start(), run.end(), MIN_MATCH):
                for k, stops in ends.items():
                    chain = chains.get(k)
                    at = bisect_right(stops, chain[2]) if chain else 0
                    if chain and (a - chain[1] > MAX_GAP or at == len(stops)):
                        self._close(k, chains.pop(k), found)
                        chain, at = None, 0
                    end = stops[at]
                    if chain is None:
                        chains[k] = [[(a, b)], b, end, b - a]
                    elif b > chain[1]:
                        chain[3] += b - max(a, chain[1])
                        chain[0].append((max(a, chain[1]), b))
                        chain[1:3] = b, end
        for k, chain in chains.items():
            self._close(k, chain, found)
        return {"n_words": len(w), "places": sorted(places), "found": found}

    def _close(self, k: int, chain: list, found: dict) -> None:
        label, template = self.parts[k]
        share = min(1.0, chain[3] / len(template))
        if share >= ENOUGH_SHARE or chain[3] >= ENOUGH_WORDS:
            old = found.get(label, (0.0, []))
            found[label] = (max(share, old[0]), sorted({*old[1], *chain[0]}))


def word_bounds(text: str | None) -> list[tuple[int, int]]:
    """Where a text's words begin and end, in bytes of UTF-8."""
    plain, at, out = utf8(text).translate(LOWER_ALNUM), 0, []
    for w in plain.split():
        at = plain.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def spans(text: str, ranges: list[tuple[int, int]], bounds: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Word ranges, in order, as ranges of code points of the text; each byte is counted once."""
    bounds, data = word_bounds(text) if bounds is None else bounds, utf8(text)
    places = sorted({x for a, b in ranges for x in (bounds[a][0], bounds[b - 1][1])})
    points, at, n = {}, 0, 0
    for x in places:
        n += len(data[at:x].decode("utf-8", "surrogatepass"))
        points[x], at = n, x
    return [(points[bounds[a][0]], points[bounds[b - 1][1]]) for a, b in ranges]


_scanner: list[Scanner] = []


def scan(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """doc_id, n_words, places, base_labels, matches (label, share, spans in code points; null if they are not asked for) for every row of docs (doc_id, text)."""
    schema = f"doc_id {kind(docs)}, n_words bigint, places array<bigint>, base_labels array<string>, matches array<struct<label:string,share:double,spans:array<array<int>>>>"

    def apply(batch: pa.RecordBatch) -> dict:
        if not _scanner:
            _scanner.append(Scanner())
        out: dict = {"n_words": [], "places": [], "base_labels": [], "matches": []}
        for text in texts(batch):
            s = _scanner[0].scan(text)
            out["n_words"].append(s["n_words"])
            out["places"].append([i for i, _ in s["places"]])
            out["base_labels"].append(sorted({x for _, x in s["places"]}))
            bounds = word_bounds(text) if with_spans and s["found"] else []
            out["matches"].append([{"label": k, "share": share, "spans": spans(text, ranges, bounds) if with_spans else None} for k, (share, ranges) in sorted(s["found"].items())])
        return out

    return map_batches(docs.select("doc_id", "text"), schema, apply)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents", "doc_id", "text"), with_spans=False)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"),
    )


def base_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_licences that hold base phrases only, which SQL can express too."""
    return op8_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _sql() -> str:
    """Phrases at every place of the words."""
    cases = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in PHRASES.items())
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({cases}),
f AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), p WHERE w[i + 1 : i + len(p)] = p)
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(i)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


BASE_SQL = _sql()
