"""Licence scans of files.

Lines, windows of consecutive lines, sentences and paragraphs of a text, and the whole text of a licence file, are compared with templates of licence
notices by the cosine of sparse TF-IDF vectors; the best template at or over ``threshold`` is the file's own licence,
and all licences found are given beside it. Words that tell licences apart (lesser, affero, a GNU version, the BSD clauses) must be there.
A file without one inherits that of the licence files in its nearest ancestor directory that has any, found by joins on
directories' paths.

Document frequencies are those of the templates, a word that no template has weighs as the rarest. From a template's
heaviest uncommon words anchors are chosen such that the others alone stay below the threshold; a text, line or sentence that
has no anchor of any template can't match and isn't compared, nor one whose words hold too little of every template.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, read

THRESHOLD = 0.8

#: Notices by SPDX identifier: fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
_MIT_TEXT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TEXT = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TEXT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {} {}"
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
#: Whole texts of the short licences.
TEMPLATES += [("MIT", _MIT_TEXT), ("ISC", _ISC_TEXT), ("BSD-2-Clause", _BSD_TEXT.format("1.", "2.", "", _BSD_END)), ("BSD-3-Clause", _BSD_TEXT.format("1.", "2.", "3. " + _BSD_THIRD, _BSD_END))]
#: The notices of the GNU licences beside the GPL.
TEMPLATES += [
    ("AGPL-3.0", _GNU.format(what="program", stop=":", comma=",", name="Affero General Public", version="3")),
    ("LGPL-3.0", _GNU.format(what="program", stop=":", comma=",", name="Lesser General Public", version="3")),
    ("LGPL-3.0", _GNU.format(what="library", stop=":", comma=",", name="Lesser General Public", version="3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", _GNU.format(what="library", stop=";", comma=";", name="Lesser General Public", version="2.1")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
]
#: Words that tell licences apart: those that a segment and a template must have alike, and those that a segment must
#: have where the template does (a GNU licence's version; the first and last part of a whole BSD text, so that the third
#: clause can't be left out between them).
ALIKE = frozenset(["lesser", "affero", "endorse"])
NEEDED = frozenset(["2", "2.1", "3"])
ENDS = frozenset(["redistributions", "tort"])
#: Words that any text has; anchors are chosen among the others where these suffice. Fixed values.
COMMON = frozenset("a all an and any are as at be but by can for from had have he his in into is it may not of on one or that the these they this to was were will with you".split())
_IDENTIFIED = "SPDX-License-Identifier: {}"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_LICENCE_FILE = r"(?i)(^|/)(un)?(license|licence|copying|notice)([-._][^/]*)?$"


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        named = [*templates, *((x, _IDENTIFIED.format(x)) for x in dict.fromkeys(x for x, _ in templates))]
        bags = [Counter(_WORD.findall(t.lower())) for _, t in named]
        df = Counter(w for b in bags for w in b)
        self.rarest = math.log(1 + len(bags)) + 1
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
        self.names, self.threshold = [x for x, _ in named], threshold
        self.alike = [ALIKE.intersection(b) for b in bags]
        self.needed = [(NEEDED.intersection(b) if "gnu" in b else frozenset()) | (ENDS.intersection(b) if ENDS <= b.keys() else frozenset()) for b in bags]
        # templates of other licences that have all words of this one: where one of them is found, this one isn't meant
        self.within = [[j for j, c in enumerate(bags) if self.names[i] != self.names[j] and b <= c and b != c] for i, b in enumerate(bags)]
        self.vectors, anchors = [], set()
        for b in bags:
            raw = {w: n * self.idf[w] for w, n in b.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            unit = {w: x / norm for w, x in raw.items()}
            self.vectors.append(unit)
            rest = 1.0
            for w in sorted(unit, key=lambda w: (w in COMMON, -unit[w], w)):
                if rest < threshold * threshold * 0.999:
                    break
                anchors.add(w)
                rest -= unit[w] ** 2
        self.anchors = frozenset(anchors)
        self.lengths = sorted({sum(b.values()) for b in bags})
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for w, x in v.items():
                self.by_word.setdefault(w, []).append((i, x))

    def cosine(self, text: str) -> tuple[float, int]:
        """The best cosine and its template; ties go to the first. One word alone is no notice: two must be shared, and
        the words that tell the template's licence from others."""
        bag = Counter(_WORD.findall(text.lower()))
        norm = math.sqrt(sum((n * self.idf.get(w, self.rarest)) ** 2 for w, n in bag.items()))
        dots: dict[int, float] = {}
        shared: Counter = Counter()
        for w, n in sorted(bag.items()):
            for i, x in self.by_word.get(w, ()):
                dots[i] = dots.get(i, 0.0) + n * self.idf[w] * x
                shared[i] += 1
        alike = ALIKE.intersection(bag)
        return max(((round(d / norm, 6), -i) for i, d in dots.items() if shared[i] > 1 and self.alike[i] == alike and self.needed[i] <= bag.keys()), default=(0.0, 0))

    def has_anchor(self, low: str) -> bool:
        return not self.anchors.isdisjoint(_WORD.findall(low))

    def may_match(self, low: str) -> bool:
        """Whether the words of a lower-cased text hold enough of any template's vector: its cosine with a text is at most
        the length of what is left of it when it loses the words that the text doesn't have."""
        held: dict[int, float] = {}
        for w in self.by_word.keys() & _WORD.findall(low):
            for i, x in self.by_word[w]:
                held[i] = held.get(i, 0.0) + x * x
        return max(held.values(), default=0.0) >= self.threshold * self.threshold * 0.999

    def windows(self, text: str, wanted) -> Iterator[str]:
        """Consecutive lines of about each template's number of words; lines without a word, of comment marks, don't
        count. A line alone is no window."""
        lines = [(x, n) for x in text.split("\n") if (n := len(_WORD.findall(x.lower())))]
        anchored = [i for i, (x, _) in enumerate(lines) if wanted(x.lower())]
        at = 0
        for i in range(len(lines) - 1):
            while at < len(anchored) and anchored[at] < i:
                at += 1
            if at == len(anchored):
                return
            ends, j, words = set(), i, lines[i][1]
            for most in self.lengths:
                while j + 1 < len(lines) and words + lines[j + 1][1] <= most:
                    j += 1
                    words += lines[j][1]
                ends |= {j, min(j + 1, len(lines) - 1)}
            for j in sorted(ends):
                if j > i and anchored[at] <= j:
                    yield " ".join(x for x, _ in lines[i : j + 1])

    def segments(self, text: str, whole: bool, wanted) -> Iterator[str]:
        """Windows of lines, paragraphs, their lines, and the sentences of both, where ``wanted`` says so of the
        lower-cased text."""
        if whole:
            yield text
        yield from self.windows(text, wanted)
        paragraph: list[str] = []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                paragraph.append(line)
                continue
            if paragraph and wanted("\n".join(paragraph).lower()):
                if len(paragraph) > 1:
                    yield " ".join(paragraph)
                    yield from (p for p in _SENTENCE.split(" ".join(paragraph)) if wanted(p.lower()))
                for x in paragraph:
                    if wanted(x.lower()):
                        yield x
                        parts = _SENTENCE.split(x)
                        if len(parts) > 1:
                            yield from (p for p in parts if wanted(p.lower()))
            paragraph = []

    def found(self, text: str | None, whole: bool) -> list[tuple[str, float]]:
        """All licences found, with their best cosines, the best first."""
        if not text or not self.may_match(text.lower()):
            return []
        by_template: dict[int, float] = {}
        for s in dict.fromkeys(self.segments(text, whole, self.has_anchor)):
            if not self.may_match(s.lower()):
                continue
            score, i = self.cosine(s)
            if score >= self.threshold:
                by_template[-i] = max(score, by_template.get(-i, 0.0))
        names: dict[str, float] = {}
        for i, score in sorted(by_template.items(), key=lambda x: (-x[1], x[0])):
            if not any(j in by_template for j in self.within[i]):
                names.setdefault(self.names[i], score)
        return list(names.items())

    def best(self, text: str | None, whole: bool) -> tuple[str | None, float | None]:
        return next(iter(self.found(text, whole)), (None, None))


def _scan(templates: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            found = [matcher.found(t, bool(w)) for t, w in zip(batch.column("text").to_pylist(), batch.column("is_file").to_pylist(), strict=True)]
            best = [f[0] if f else (None, None) for f in found]
            every = pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string()))
            yield pa.record_batch([batch.column("id"), batch.column("path"), batch.column("is_file"), pa.array([x for x, _ in best], pa.string()), pa.array([s for _, s in best], pa.float64()), every], names=["id", "path", "is_file", "license", "score", "licenses"])

    return run


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license (SPDX identifier), score, origin ("file", "header" or "inherited"), declared_in (a directory),
    licenses (all that the row's own text names, the best first; empty if none).

    Directories are separated by "/"; the directory of a path without one is "". Licences of the licence
    files in one directory are joined by " OR " in order. Nothing found, in an empty or null text or on the way up, gives
    nulls; a null path is in no directory and inherits nothing. Every row gets its own answer, repeated ones too; an
    empty table gives an empty result. Other columns play no part.
    """
    rows = files.select(files[f"`{id_col}`"].cast("long").alias("id"), files[f"`{path_col}`"].cast("string").alias("path"), files[f"`{text_col}`"].alias("text"))
    rows = rows.withColumn("is_file", F.coalesce(F.col("path").rlike(_LICENCE_FILE), F.lit(False)))
    own = rows.mapInArrow(_scan(templates, threshold), "id long, path string, is_file boolean, license string, score double, licenses array<string>")
    own, _ = materialise(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licenses-own")
    declared = own.where("is_file").select("dir", F.explode("licenses").alias("license")).groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("license")), " OR ").alias("given"))
    # ancestors of each directory that has files, itself first
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"), parts.alias("parts"))
    up = up.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    # an absolute path's "" part makes depth 0 and 1 the same directory
    near = up.join(declared.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("given", "above"), "depth").alias("near"))
    near, _ = materialise(near.select("dir", "near.given", "near.above"), "licenses-directories")
    out = own.join(near, "dir", "left")
    found = F.col("license").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("license", "given").alias("license"),
        "score",
        F.when(found & F.col("is_file"), "file").when(found, "header").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(found, F.col("dir")).otherwise(F.col("above")).alias("declared_in"),
        "licenses",
    )


#: Documents of up to so many characters are laid out as licence files by op4_licenses().
SHORT_CHARS = 200


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree. The table has no paths, so they are laid out by a rule: a document is the file
    ``<source>/<doc_id div 50>/<doc_id>.txt``, but one of at most SHORT_CHARS characters is ``<source>/LICENSE.<doc_id>``,
    a licence file, if it names a licence, from which the files below inherit. ``license`` is what a document's own text
    names, ``inherited_license`` what one without gets from its directories."""
    source, name = F.coalesce("source", F.lit("unknown")), F.col("doc_id").cast("string")
    inside = F.concat(F.floor(F.col("doc_id") / 50).cast("string"), F.lit("/"), name, F.lit(".txt"))
    path = F.concat(source, F.lit("/"), F.when(F.char_length("text") <= SHORT_CHARS, F.concat(F.lit("LICENSE."), name)).otherwise(inside))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    out, inherited = scan_licenses(docs, "doc_id", "path").withColumnRenamed("id", "doc_id"), F.col("origin") == "inherited"
    return out.withColumn("inherited_license", F.when(inherited, F.col("license"))).withColumn("license", F.when(~inherited, F.col("license")))
