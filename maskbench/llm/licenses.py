"""License scan: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.9

# Phrases and the labels that they stand for.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Short notices by which licenses are named in files, and their labels.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("rights-reserved", "All rights reserved."),
]

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as
published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."""

# License texts without title and holder, and the headers that long licenses ask files to carry. Versions of the
# GNU headers differ in one or two words, so that either version matches.
TEXTS = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause-text", _BSD_2 + _BSD_END),
    ("bsd-3-clause-text", _BSD_2 + _BSD_3 + _BSD_END),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("gpl-header", _GNU.format("program", "", "2")),
    ("lgpl-header", _GNU.format("library", "Lesser ", "2.1")),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

#: A block has up to LINES lines of any length, or any number of lines with at most SLACK times the template's words.
LINES, SLACK = 4, 2

#: Everything that is not a letter, a digit or a byte above ASCII separates words.
SPACES = bytes(32 if i < 0x30 or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))
MATCH = "struct<label:string,block:int,first_word:bigint,last_word:bigint,containment:double>"
MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("block", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))


def words_of(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes after lower-casing A to Z."""
    return raw.lower().translate(SPACES).split()


def _raw(column: pa.Array) -> Iterator[bytes]:
    for t in column:
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def token_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many documents each token of the templates occurs: as many rows as the templates have tokens."""
    vocabulary = {w for _, t in templates for w in words_of(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(sorted(vocabulary), 0)
        for b in batches:
            for raw in _raw(b.column(0)):
                for w in vocabulary.intersection(words_of(raw)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r["token"]): r["n"] for r in rows}


class Index:
    """Templates as sets in the order of global frequency, and which of them each prefix token leads to."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.order = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.order[w] for w in words_of(t.encode())}) for _, t in templates]
        self.words = [len(words_of(t.encode())) for _, t in templates]
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            # a block that holds ``need`` of a set's tokens holds one of its first len - need + 1
            for at, token in enumerate(s[:len(s) - self.need[k] + 1]):
                self.lists.setdefault(token, []).append((k, at))
        self.prefix = {w for w, i in self.order.items() if i in self.lists}

    def matches(self, words: list[bytes]) -> list[int]:
        """Every template whose tokens the words hold to the threshold."""
        own = sorted({self.order[w] for w in self.order.keys() & set(words)})
        at_of = {t: i for i, t in enumerate(own)}
        tried, out = set(), []
        for token in own:
            for k, at in self.lists.get(token, ()):
                s, need = self.sets[k], self.need[k]
                if k in tried or len(own) < need:             # length: fewer shared tokens than are needed
                    continue
                tried.add(k)
                # position: the first shared token, and at most what follows it on either side
                if 1 + min(len(s) - at - 1, len(own) - at_of[token] - 1) + sum(t in at_of for t in s[:at]) < need:
                    continue
                if sum(t in at_of for t in s) >= need:
                    out.append(k)
        return out

    def block(self, k: int, lines: list[list[bytes]], starts: list[int]) -> tuple[float, int, int] | None:
        """(containment, first line, line after the last) of the block that holds most of template k, if that is enough.

        A longer block holds no less, so only the longest block from each line is counted, by adding lines at its
        end and taking them off at its start. Of equal blocks the first is taken, without lines that it can spare.
        """
        own = set(self.sets[k])
        have = [[t for w in x if (t := self.order.get(w)) in own] for x in lines]
        limit, held, j, most, at = SLACK * self.words[k], Counter(), 0, 0, 0
        for i in range(len(lines)):
            while j < len(lines) and (j < i + LINES or starts[j + 1] - starts[i] <= limit):
                held.update(have[j])
                j += 1
            if len(held) > most:
                most, at = len(held), i
            held.subtract(have[i])
            held = +held if have[i] else held
        if most < self.need[k]:
            return None
        seen, end = set(have[at]), at + 1
        while len(seen) < most:
            seen.update(have[end])
            end += 1
        while len(set().union(*have[at + 1:end])) == most:
            at += 1
        return most / len(own), at, end


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n, head = len(phrase), phrase[0]
    return [i for i, w in enumerate(words) if w == head and words[i:i + n] == phrase]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = [*TEMPLATES, *TEXTS], phrases: list[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Find license phrases, notices, texts and headers in whole texts.

    A text block is a run of lines that follow one another: up to four lines of any length, or any number of
    lines with at most twice the template's words, so that wrapped templates are found however short the lines.
    A block matches a template when it holds at least ``threshold`` of the template's distinct tokens. Tokens
    are ordered by the number of documents that hold them, rarest first; only a document with a token of a
    template's prefix is looked at, and lengths and positions decide before its blocks are counted. The
    templates are few and travel with the job; documents stay where they are.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (their smallest and largest
    start, else null), base_labels, labels (those and the templates', sorted, joined by commas), score (1 with
    a phrase, else the largest containment, 0 without a match) and matches (label, first line, first and last
    word, containment). Null text is empty; a null id is kept; repeated rows are scanned each; other columns
    are left out; an empty table gives an empty result.
    """
    index = Index(templates, token_counts(docs, templates), threshold)
    wanted = [(words_of(p.encode()), label) for p, label in phrases]
    heads = {w[0] for w, _ in wanted}
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def one(raw: bytes) -> tuple:
        words = words_of(raw)
        places, base = [], set()
        if not heads.isdisjoint(words):
            for phrase, label in wanted:
                at = _places(words, phrase)
                places += at
                if at:
                    base.add(label)
        best: dict[int, tuple[float, int, int, int]] = {}
        if not index.prefix.isdisjoint(words):
            lines, starts = [words_of(x) for x in raw.split(b"\n")], [0]
            for x in lines:
                starts.append(starts[-1] + len(x))
            for k in index.matches(words):
                at = index.block(k, lines, starts)
                if at:
                    c, i, j = at
                    best[k] = (c, i, starts[i], max(starts[i], starts[j] - 1))
        found = sorted((index.labels[k], *v) for k, v in best.items())
        labels = sorted(base | {f[0] for f in found})
        score = 1.0 if base else max([0.0, *(f[1] for f in found)])
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score,
                [{"label": a, "block": i, "first_word": x, "last_word": y, "containment": c} for a, c, i, x, y in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), MATCH_ARROW]
        for b in batches:
            rows = [one(raw) for raw in _raw(b.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<{MATCH}>")
