"""License scan against a plain computation."""

import math
import re
from collections import Counter

from shelfmark.llm.licenses import LICENSE_FILE, TEMPLATES, TEXTS, THRESHOLD, TRIGGER, scan_licenses, terms
from shelfmark.llm.queries import QUERIES


def units(text, whole):
    lines = text.split("\n")
    out = [x for x in lines if x.strip() and re.search(TRIGGER, x)]
    for block in re.split(r"\n(?:[ \t\r\x0b\x0c]*\n)+", text):
        inner = [x for x in block.split("\n") if x.strip()]
        if len(inner) > 1 and any(re.search(TRIGGER, x) for x in inner):
            out.append(" ".join(inner))
    return [terms(x) for x in out] + ([terms(text)] if whole else [])


def expected(rows):
    """(path, license, score, how, from) by comparing every passage with every template, and walking up."""
    name = lambda p: p.rpartition("/")[2] if p else ""
    found = []
    for p, t in rows:
        whole = bool(re.search(LICENSE_FILE, name(p)))
        found.append((p, units(t, whole) if t and (whole or re.search(TRIGGER, t)) else []))
    known = {t for texts in TEMPLATES.values() for x in texts for t in terms(x)}
    n, total = Counter(), 0
    for _, u in found:
        for v in u:
            total += 1
            n.update(known & v.keys())
    idf = lambda t: 1 + math.log((1 + total) / (1 + n[t])) if t in known else 1 + math.log(1 + total)

    def cosine(a, b):
        dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a if t in b)
        return dot / math.sqrt(sum((x * idf(t)) ** 2 for t, x in a.items()) * sum((x * idf(t)) ** 2 for t, x in b.items()))

    own = []
    for p, u in found:
        best = max(((round(cosine(v, terms(x)), 9), k) for v in u if v for k, texts in TEMPLATES.items() for x in texts), default=(0, None), key=lambda b: b[0])
        own.append(best if best[0] >= THRESHOLD else (None, None))
    given = {}
    for (p, _), (score, k) in zip(rows, own):
        if p is not None and score and re.search(LICENSE_FILE, name(p)):
            d = p.rpartition("/")[0]
            given[d] = min(given.get(d, (0, "~", "~")), (-score, k, p))
    out = []
    for (p, _), (score, k) in zip(rows, own):
        if score:
            out.append((p, k, round(score, 6), "own", p))
            continue
        d = p.rpartition("/")[0] if p is not None else None
        while d is not None and d not in given:
            d = d.rpartition("/")[0] if d else None
        out.append((p, given[d][1], round(-given[d][0], 6), "inherited", given[d][2]) if d is not None else (p, None, None, None, None))
    return out


def check(df, rows):
    got = [(r.path, r.license, r.license_score and round(r.license_score, 6), r.license_how, r.license_from) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
ROWS = [
    ("LICENSE", "MIT License\n\n" + MIT), ("a/b/c/x.py", "# plain"), ("a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
    ("a/b/COPYING", "no license words of use here"), ("a/b/y.py", "# SPDX-License-Identifier: GPL-3.0\ncode"), ("a/b/c/d/z", None),
    ("a2/x", ""), ("a2/x", ""), (None, "Released under the MIT License."), (None, None), ("/abs/dir/f", "x"), ("q/NOTICE", "Licensed under CC BY 4.0."),
    ("q/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("q/r/s.txt", "we sell licences"),
    ("q/long.txt", "word " * 50_000 + "\nReleased under the MIT License.\n" + "more\n" * 20_000), ("a/license-notes/k.txt", "hi"),
]


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "path string, text string, license string, `_0` int")
    out = scan_licenses(df)
    assert out.columns == ["path", "_0", "license", "license_score", "license_how", "license_from"]
    check(out, ROWS)
    assert scan_licenses(df.where("path = 'nowhere'")).count() == 0


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op10_license_scan"](spark, folder)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [(r.path, text[r.doc_id]) for r in out.collect()]
    check(out, rows)
    assert {r.license for r in out.collect()} == {None, "MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"}


def gnu(program, name, version):
    return f"""    This {program} is free software; you can redistribute it and/or modify
    it under the terms of the GNU {name} as published by
    the Free Software Foundation; either version {version} of the License, or
    (at your option) any later version.

    This {program} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {name} for more details."""


HEADERS = {
    "GPL-2.0": gnu("program", "General Public License", "2"), "GPL-3.0": gnu("program", "General Public License", "3"),
    "LGPL-2.1": gnu("library", "Lesser General Public License", "2.1"), "LGPL-3.0": gnu("library", "Lesser General Public License", "3"),
    "AGPL-3.0": gnu("program", "Affero General Public License", "3"),
}


def test_real_headers_and_files(spark):
    """Headers as they stand in files, whole texts, both also on one line; without and with other files around."""
    want, rows = {}, []

    def add(path, name, text):
        want[path] = name
        rows.append((path, text))

    line = lambda t: " ".join(t.split())
    for name, text in HEADERS.items():
        add(f"h/{name}.c", name, f"/*\n{text}\n*/\nint main;\n")
        add(f"h/{name}.py", name, "\n".join(f"# {x}" for x in text.split("\n")) + "\ncode\n")
        add(f"h/{name}.js", name, f"// {line(text)}\ncode\n")
    for name, (text,) in TEXTS.items():
        add(f"{name}/LICENSE", name, "Copyright (c) 2020 Some Body\n\n" + text)
        add(f"{name}-line/COPYING", name, line(text))
        add(f"{name}-line/below/x.py", name, "code")
    permission = next(p for p in TEXTS["MIT"][0].split("\n\n") if p.startswith("Permission"))
    add("m/x.py", "MIT", "# " + line(permission) + "\ncode\n")
    add("m/y.py", "MIT", "".join(f"# {x}\n" for x in TEXTS["MIT"][0].split("\n")) + "code\n")
    add("m/b2.py", "BSD-2-Clause", "".join(f"# {x}\n" for x in TEXTS["BSD-2-Clause"][0].split("\n")) + "code\n")
    add("m/b3.py", "BSD-3-Clause", "".join(f"# {x}\n" for x in TEXTS["BSD-3-Clause"][0].split("\n")) + "code\n")
    prose = [(f"n/{i}/LICENSE", "The people of the town go to the sea, and the sea is of use to the people and the town. " * 40) for i in range(60)]
    for more in ([], prose):
        out = {r.path: r.license for r in scan_licenses(spark.createDataFrame(rows + more, "path string, text string")).collect()}
        assert {p: n for p, n in out.items() if n != want.get(p)} == {}
