"""License scan: base phrases, and an exact set-similarity join of text blocks and notice templates.

A block is a run of neighbouring lines (those without a word left out): from every line on as many as have
`SLACK` times the template's words together, at least that line. So wrapped notices, also of several
paragraphs, are found whole, and words scattered over a long text are not. A block belongs to a
template when it holds at least `THRESHOLD` of the template's distinct words, among them those that the
template needs: words that set it apart (affero, lesser, a version). Where the needs of one match are a
part of those of another at the same line, as GPL's of LGPL's, the fuller one alone counts.

The join is exact: words stand in one global order, rarest first by their document counts over the whole
corpus; a template's prefix is so long that a matching block must hold a word of it (prefix filter), a
block needs enough words (length filter), and what stands behind the first shared word on both sides
must suffice (positional filter). Documents pass these filters first, then their blocks, and only then
are two sets intersected. Words of no template take no part in any overlap and are left out of
the sets.

Defined cases: null text is empty, with zero words and null places; a text without a hit has empty
labels and score 0; repeated phrases count each time; equal texts give equal rows; extra columns
are returned only when named in keep. The templates are replicated to the tasks, so their number
is checked against a bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import WHOLE_BATCH, map_batches

THRESHOLD = (9, 10)
SLACK = 2
MOST_TEMPLATES = 10_000

# Base phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices of well-known public licenses: label, words that it needs, text.
TEMPLATES = (
    ("agpl-3.0", "gnu affero general 3", "Licensed under the GNU Affero General Public License version 3"),
    ("agpl-3.0", "gnu affero general 3",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
     " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
     " (at your option) any later version."),
    ("apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache 2",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at Unless required by applicable law or"
     " agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
     " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
     " governing permissions and limitations under the License."),
    ("bsd", "redistribution binary",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
     " the following conditions are met"),
    ("bsd-2-clause", "redistribution binary disclaimer",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
     " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
     " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
     " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
     " other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND"
     " CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
     " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
     " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
     " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
     " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
     " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
     " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "redistribution binary disclaimer endorse promote",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
     " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
     " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
     " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
     " other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of"
     " its contributors may be used to endorse or promote products derived from this software without specific"
     " prior written permission."),
    ("bsl-1.0", "boost 1", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "attribution 4",
     "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "cc by 4", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "attribution noncommercial 4",
     "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "cc by nc 4", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa-4.0", "attribution sharealike 4",
     "Licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "cc by sa 4", "Licensed under CC BY SA 4.0"),
    ("cc0-1.0", "waived", "To the extent possible under law, the author has waived all copyright"),
    ("gpl-2.0", "gnu general 2", "Licensed under the GNU General Public License version 2"),
    ("gpl-2.0", "gnu general 2",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
     " option) any later version."),
    ("gpl-3.0", "gnu general 3", "Licensed under the GNU General Public License version 3"),
    ("gpl-3.0", "gnu general 3",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
     " option) any later version."),
    ("isc", "permission fee",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted"),
    ("lgpl-2.1", "gnu lesser general 2 1", "Licensed under the GNU Lesser General Public License version 2.1"),
    ("lgpl-2.1", "gnu lesser general 2 1",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
     " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"
     " (at your option) any later version."),
    ("lgpl-3.0", "gnu lesser general 3", "Licensed under the GNU Lesser General Public License version 3"),
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "Licensed under the MIT License"),
    ("mit", "permission charge",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files"),
    ("mit", "permission charge merge sublicense",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
     " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
     " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
     " conditions: The above copyright notice and this permission notice shall be included in all copies or"
     " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
     " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
     " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
     " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
     " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "mozilla 2",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "unencumbered",
     "This is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be"
     " held liable for any damages arising from the use of this software. Permission is granted to anyone to use"
     " this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
     " subject to the following restrictions: 1. The origin of this software must not be misrepresented"),
)

# A-Z become a-z; other ASCII signs than letters and digits become blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def places(words: list[bytes], phrase: bytes) -> list[int]:
    """Word positions at which the words of the phrase stand one after another."""
    text, found = b" " + b" ".join(words) + b" ", []
    at, seen, last = text.find(phrase), 0, 0
    while at >= 0:
        seen += text.count(b" ", last, at)
        last = at
        found.append(seen)
        at = text.find(phrase, at + 1)
    return found


class Template:
    """A notice: label, distinct words in the global order, those it needs, and the words of a block."""

    def __init__(self, label: str, needs: str, text: str, rank: dict[bytes, int], threshold: tuple[int, int]):
        words = words_of(text)
        self.label, self.needs = label, frozenset(words_of(needs))
        self.words = frozenset(words)
        self.ordered = sorted(self.words, key=rank.__getitem__)
        self.need = -(-threshold[0] * len(self.words) // threshold[1])
        self.prefix = frozenset(self.ordered[:len(self.words) - self.need + 1])
        self.room = SLACK * len(words)


class Index:
    """The prefixes of the templates in the global order, for one pass over texts."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], frequency: dict[bytes, int],
                 threshold: tuple[int, int]):
        every = sorted({w for _, _, t in templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.templates = [t for x in templates if (t := Template(*x, self.rank, threshold)).words]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for number, t in enumerate(self.templates):
            for i, w in enumerate(t.ordered):
                if w in t.prefix:
                    self.prefix.setdefault(w, []).append((number, i))

    def candidates(self, words: set[bytes]) -> list[Template]:
        """The templates that a text of these words may hold, by prefix, length and position."""
        own = sorted(words & self.rank.keys(), key=self.rank.__getitem__)
        tried, out = set(), []
        for j, w in enumerate(own):
            for number, i in self.prefix.get(w, ()):
                t = self.templates[number]
                if number in tried or len(own) < t.need:
                    continue
                tried.add(number)  # this is the first word they share
                if min(len(t.words) - i, len(own) - j) >= t.need and t.needs <= words:
                    out.append(t)
        return out

    def matches(self, lines: list[list[bytes]]) -> dict[str, float]:
        """Label -> containment for the templates that a block of a text satisfies; lines: with words."""
        found: dict[str, float] = {}
        per_line: dict[int, list[tuple[Template, float]]] = {}
        for t in self.candidates({w for line in lines for w in line}):
            for start, share in self._blocks(t, lines):
                per_line.setdefault(start, []).append((t, share))
        for hits in per_line.values():
            for t, share in hits:
                if not any(t.needs < other.needs for other, _ in hits):
                    found[t.label] = max(found.get(t.label, 0.0), share)
        return found

    @staticmethod
    def _blocks(t: Template, lines: list[list[bytes]]) -> Iterator[tuple[int, float]]:
        """(first line, containment) of the blocks that match a template; the end only moves on."""
        held: dict[bytes, int] = {}
        end = words = prefixes = 0

        def put(line: list[bytes], by: int) -> None:
            nonlocal words, prefixes
            words += by * len(line)
            for w in line:
                if w in t.words:
                    held[w] = held.get(w, 0) + by
                    prefixes += by * (w in t.prefix)
                    if not held[w]:
                        del held[w]

        for start in range(len(lines)):
            while end < len(lines) and (end == start or words + len(lines[end]) <= t.room):
                put(lines[end], 1)
                end += 1
            if prefixes and len(held) >= t.need and t.needs <= held.keys():
                yield start, len(held) / len(t.words)
            put(lines[start], -1)


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """Of every word of the vocabulary, in how many documents it stands; all documents count."""
    def count(batch):
        seen: dict[bytes, int] = {}
        for t in batch["t"].to_pylist():
            for w in vocabulary.intersection(words_of(t)):
                seen[w] = seen.get(w, 0) + 1
        return pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()),
                                           "n": pa.array(list(seen.values()), pa.int64())})

    rows = map_batches(docs.select(F.col(text).alias("t")), count, "w binary, n bigint", WHOLE_BATCH)
    return {bytes(w): n for w, n in rows.groupBy("w").agg(F.sum("n")).collect()}


def scan(docs: DataFrame, keep: Sequence[str], text: str = "text",
         templates: Sequence[tuple[str, str, str]] = TEMPLATES,
         phrases: Sequence[tuple[str, str]] = PHRASES,
         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The columns in keep, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the largest containment of a matched template.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates")
    vocabulary = frozenset(w for _, _, t in templates for w in words_of(t))
    index = Index(templates, document_counts(docs, vocabulary, text), threshold)
    wanted = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    narrow = docs.select(*cols, F.col(text).cast("string").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    made = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
            " base_labels string, labels string, score double")

    def one(t: str | None) -> tuple:
        words = words_of(t)
        base, at = set(), []
        for phrase, label in wanted:
            if found := places(words, phrase):
                base.add(label)
                at += found
        hits: dict[str, float] = {}
        if not index.prefix.keys().isdisjoint(words) and index.candidates(set(words)):
            hits = index.matches([x for x in map(words_of, t.split("\n")) if x])
        score = 1.0 if base else max(hits.values(), default=0.0)
        return (len(words), len(at), min(at, default=None), max(at, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | hits.keys())), score)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def work(batch):
        rows = list(zip(*(one(t) for t in batch["t"].to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
            [*names, *(x.split()[0] for x in made.split(", "))])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), made])
    done = map_batches(narrow, work, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
                       *(x.split()[0] for x in made.split(", ")))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL, with plain set intersections in place of the filtered join."""
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def at(phrase: str) -> str:
        same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        return f"list_filter(range(len(w)), lambda i: {same})"

    base = ", ".join(f"{at(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))
    every = " || ".join(f"p{i}" for i in range(len(PHRASES)))
    named = " || ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE [] END"
                        for i, (_, label) in enumerate(PHRASES))
    def listed(words):
        return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"

    notices = ", ".join(
        f"({i}, '{label}', list_distinct({listed(words_of(t))}), {listed(words_of(needs))}, {SLACK * len(words_of(t))})"
        for i, (label, needs, t) in enumerate(TEMPLATES))
    up, down = THRESHOLD
    text = "coalesce(text, '')"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({lower.format(text)}, {words}) AS w FROM {table}),
    b AS (SELECT doc_id, len(w) AS n_words, {base} FROM d),
    t(number, label, s, needs, room) AS (VALUES {notices}),
    l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, w,
                 sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
          FROM (SELECT doc_id, i, regexp_extract_all({lower.format("line")}, {words}) AS w FROM (
                SELECT doc_id, unnest(string_split({text}, chr(10))) AS line,
                       generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {table}))
          WHERE len(w) > 0),
    q AS (SELECT doc_id, list(DISTINCT x) AS s FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id),
    c AS (SELECT doc_id, number FROM q, t
          WHERE {down} * len(list_intersect(q.s, t.s)) >= {up} * len(t.s) AND len(list_intersect(q.s, needs)) = len(needs)),
    k AS (SELECT c.number, l.doc_id, l.i, list_distinct(flatten(list(n.w))) AS s
          FROM c JOIN t USING (number) JOIN l ON l.doc_id = c.doc_id JOIN l AS n ON n.doc_id = l.doc_id AND n.i >= l.i
               AND (n.i = l.i OR n.upto - l.upto + len(l.w) <= room)
          GROUP BY ALL),
    m0 AS (SELECT doc_id, i, label, needs, len(list_intersect(k.s, t.s)) / len(t.s) AS share FROM k JOIN t USING (number)
           WHERE {down} * len(list_intersect(k.s, t.s)) >= {up} * len(t.s)
                 AND len(list_intersect(k.s, needs)) = len(needs)),
    m AS (SELECT * FROM m0 WHERE NOT EXISTS (
              SELECT 1 FROM m0 AS o WHERE o.doc_id = m0.doc_id AND o.i = m0.i AND len(o.needs) > len(m0.needs)
                     AND len(list_intersect(o.needs, m0.needs)) = len(m0.needs))),
    h AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY doc_id),
    r AS (SELECT b.*, list_sort({every}) AS places, {named} AS base, h.labels AS more, share
          FROM b LEFT JOIN h USING (doc_id))
    SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
           places[1]::BIGINT AS first_word, places[len(places)]::BIGINT AS last_word,
           array_to_string(list_sort(base), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
           CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM r"""
