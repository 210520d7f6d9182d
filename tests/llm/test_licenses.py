import math
import re
import textwrap

import numpy as np
import pytest

from ledgerline.llm.licenses import TEMPLATES, THRESHOLD, Matcher, op4_licenses, scan_licenses

M = Matcher(TEMPLATES, THRESHOLD)
LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}


def brute(text, whole):
    """All segments, no anchors."""
    best = max((M.cosine(s) for s in M.segments(text or "", whole, lambda _: True)), default=(0.0, 0))
    return (M.names[-best[1]], best[0]) if best[0] >= THRESHOLD else (None, None)


def test_every_template_is_its_own():
    for name, text in TEMPLATES:
        assert M.best(text, False)[0] == name
        assert M.best("# " + text.replace(" the ", " the\n# ") + "\n\nprose follows here", False)[0] == name
        assert M.best(f"// SPDX-License-Identifier: {name}\nint x;", False)[0] == name


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_licenses(spark, d).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert (got[i].license, got[i].score) == brute(t, False)
        named = [x for x in LINES if x in t]
        if len(named) == 1:
            assert got[i].license == LINES[named[0]]
        if got[i].license and not named:  # a changed copy of a notice
            assert "icense" in t
    assert sum(r.license is not None for r in got.values()) > 10


def test_inheritance_and_odd_rows(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x.py", "code"),
        (3, "a/b/c/y.py", None),
        (4, "a/b/LICENSE-APACHE", "Licensed under the Apache License, Version 2.0."),
        (5, "a/b/LICENSE-MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction"),
        (6, "a/b/c/z.py", "# Licensed under CC BY 4.0.\ncode"),
        (7, "d/e.py", ""),
        (8, None, "Licensed under CC BY-SA 4.0. And more prose that follows in the same line"),
        (9, None, "nothing"),
        (10, "a/license_check.py", "x"),
        (11, "ab/x.py", "a directory whose name begins with another's"),
        (12, "/r/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (13, "/r/s/t.c", "x"),
        (None, "a/x.py", "code"),
        (2, "a/x.py", "code"),
        (14, "top.txt", "word " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "id long, path string, text string, license string, score double")
    got = sorted(((r.id, r.license, r.origin, r.declared_in) for r in scan_licenses(df, "id", "path").collect()), key=str)
    both = "Apache-2.0 OR MIT"
    want = [(1, "MIT", "file", "a"), (2, "MIT", "inherited", "a"), (3, both, "inherited", "a/b"), (4, "Apache-2.0", "file", "a/b"), (5, "MIT", "file", "a/b"), (6, "CC-BY-4.0", "header", "a/b/c"), (7, None, None, None), (8, "CC-BY-SA-4.0", "header", None), (9, None, None, None), (10, "MIT", "inherited", "a"), (11, None, None, None), (12, "GPL-3.0", "file", "/r"), (13, "GPL-3.0", "inherited", "/r"), (None, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (14, None, None, None)]
    assert got == sorted(want, key=str)
    assert scan_licenses(df.limit(0), "id", "path").count() == 0


@pytest.mark.parametrize("text", ["the license of the gnu", "version 2.0 of this", "permission to use the software", "mit", "Public domain software license notice version 2.0"])
def test_anchors_lose_nothing(text):
    assert M.best(text, False) == brute(text, False)
    assert all(re.fullmatch(r"[a-z0-9.-]+", a) for a in M.anchors)


GPL_HEADER = """# Copyright (C) 2020 A. Author
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
import os
"""


def wrapped(name, width=70):
    text = max((t for x, t in TEMPLATES if x == name), key=len)
    return "\n".join(textwrap.wrap(text, width))


def test_wrapped_notices_among_other_lines():
    assert M.best(GPL_HEADER, False)[0] == "GPL-3.0"
    for name in ("MIT", "ISC"):
        file = f"{name} License\n\nCopyright (c) 2021 Some Body\n\n{wrapped(name)}\n"
        assert M.best(file, True)[0] == name and M.best(file, False)[0] == name
    assert M.best("words of other matters. Licensed under the\nMIT License. Then follows something else\nof no import", False)[0] == "MIT"
    assert M.best("one line\nand another\n# \nand a third", False) == (None, None)


def gnu(what, name, version, stop=":"):
    return f"/* This {what} is free software{stop} you can redistribute it and/or\n * modify it under the terms of the GNU {name} General Public\n * License as published by the Free Software Foundation; either\n * version {version} of the License, or (at your option) any later version.\n */\nint x;"


def test_notices_get_their_own_licence():
    assert M.best("This work is licensed under the GNU Lesser General Public License, version 3.", False)[0] == "LGPL-3.0"
    for what in ("program", "library"):
        assert M.best(gnu(what, "Lesser", "3"), False)[0] == "LGPL-3.0"
    assert M.best(gnu("library", "Lesser", "2.1", ";"), False)[0] == "LGPL-2.1"
    assert M.best(gnu("program", "Affero", "3"), False)[0] == "AGPL-3.0"
    assert M.best(gnu("program", "", "2", ";"), False)[0] == "GPL-2.0"
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        for width in (60, 79, 5000):
            assert [x for x, _ in M.found("Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + wrapped(name, width), True)] == [name]


def test_all_licences_are_returned(spark):
    text = "Released under the MIT License.\nprose between\nLicensed under the Apache License, Version 2.0."
    assert sorted(x for x, _ in M.found(text, False)) == ["Apache-2.0", "MIT"]
    df = spark.createDataFrame([(1, "a/LICENSE", text), (2, "a/x.py", "code")], "id long, path string, text string")
    got = {r.id: r for r in scan_licenses(df, "id", "path").collect()}
    assert sorted(got[1].licenses) == ["Apache-2.0", "MIT"] and got[2].licenses == []
    assert (got[2].license, got[2].origin) == ("Apache-2.0 OR MIT", "inherited")


def test_inheritance_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "concat(source, '/', doc_id, '.txt') AS path")
    given = docs.select("path").distinct().collect()
    dirs = sorted({r.path.split("/")[0] for r in given})[::2]
    files = spark.createDataFrame([(-1 - n, "Released under the MIT License.", f"{x}/LICENSE") for n, x in enumerate(dirs)], docs.schema)
    alone = {r.id: r.license for r in scan_licenses(docs, "doc_id", "path").collect()}
    for r in scan_licenses(docs.unionByName(files), "doc_id", "path").collect():
        if r.id >= 0:
            own, below = alone[r.id], r.path.split("/")[0] in dirs
            assert (r.license, r.origin) == ((own, "header") if own else ("MIT", "inherited") if below else (None, None))


def plain_cosine(text, template, bags):
    """TF-IDF by its formula, over dense vectors of all words of both."""
    words = [re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", x.lower()) for x in (text, template)]
    both = sorted({*words[0], *words[1]})
    n = len(bags)
    idf = np.array([math.log((1 + n) / (1 + sum(w in b for b in bags))) + 1 for w in both])
    a, b = (np.array([ws.count(w) for w in both]) * idf for ws in words)
    return float(a @ b / math.sqrt((a @ a) * (b @ b))) if len(both) else 0.0


def test_cosine_is_that_of_dense_vectors():
    names = dict.fromkeys(n for n, _ in TEMPLATES)
    texts = [t for _, t in TEMPLATES] + [f"SPDX-License-Identifier: {n}" for n in names]
    bags = [set(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())) for t in texts]
    for s in [*texts[::3], "Some prose, then: Licensed under the MIT License", "released to the public domain", "this work is free of any license 2.0 or version 3 2.0"]:
        score, i = M.cosine(s)
        assert score == pytest.approx(plain_cosine(s, texts[-i], bags), abs=2e-6) if score else True
        own = {w for w in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", s.lower())}
        may = [j for j, b in enumerate(bags) if len(b & own) > 1 and M.needed[j] <= own and M.alike[j] == {"lesser", "affero", "endorse"} & own]
        assert score == pytest.approx(max((plain_cosine(s, texts[j], bags) for j in may), default=0.0), abs=2e-6)
        assert M.may_match(s.lower()) or score < THRESHOLD


def test_query_has_files_headers_and_heirs(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_licenses(spark, d).collect()}
    given = {}
    for i, r in docs.items():
        if r.text is not None and len(r.text) <= 200:
            given.setdefault(r.source, set()).update(got[i].licenses)
    seen = set()
    for i, r in docs.items():
        file, above = r.text is not None and len(r.text) <= 200, " OR ".join(sorted(given.get(r.source, ())))
        want = ("file" if file else "header") if got[i].license else "inherited" if above else None
        assert (got[i].origin, got[i].inherited_license) == (want, above if want == "inherited" else None)
        seen.add(want)
    assert seen == {"file", "header", "inherited", None}
