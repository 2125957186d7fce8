"""License scans: TF-IDF cosine to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage



def _whole(name: str) -> str:
    return resources.files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")


def _gnu(program: str, license_: str, version: str) -> tuple[str, str]:
    """The standard header of a GNU license, its first paragraph and the whole."""
    first = (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {license_} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    return first, (
        f"{first} This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license_} for more details. You should have received a copy "
        f"of the GNU {license_} along with this {program}. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole texts of licenses; the short ones are also headers.
TEXTS: Mapping[str, Sequence[str]] = {
    name: (_whole(name),)
    for name in (
        "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC",
        "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
    )
}
#: The cosine from which a licence file is a whole text: long texts are alike by their common words.
WHOLE = 0.9
# Public license identifiers with notices and headers by which they are known.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "AGPL-3.0": (
        "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
        *_gnu("program", "Affero General Public License", "3"),
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD 2-Clause License.", *TEXTS["BSD-2-Clause"]),
    "BSD-3-Clause": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        *TEXTS["BSD-3-Clause"],
    ),
    "CC-BY-4.0": ("SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-SA-4.0": ("SPDX-License-Identifier: CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    "GPL-2.0": (
        "SPDX-License-Identifier: GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2.",
        *_gnu("program", "General Public License", "2"),
    ),
    "GPL-3.0": (
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        *_gnu("program", "General Public License", "3"),
    ),
    "ISC": ("SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", *TEXTS["ISC"]),
    "LGPL-2.0": ("SPDX-License-Identifier: LGPL-2.0", *_gnu("library", "Library General Public License", "2")),
    "LGPL-2.1": (
        "SPDX-License-Identifier: LGPL-2.1",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        *_gnu("library", "Lesser General Public License", "2.1"),
        *_gnu("program", "Lesser General Public License", "2.1"),
    ),
    "LGPL-3.0": (
        "SPDX-License-Identifier: LGPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        *_gnu("library", "Lesser General Public License", "3"),
        *_gnu("program", "Lesser General Public License", "3"),
    ),
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        *(p for p in TEXTS["MIT"][0].split("\n\n") if p.startswith("Permission")),
        *TEXTS["MIT"],
    ),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", *TEXTS["Unlicense"]),
}
#: What a line must hold to be looked at.
TRIGGER = r"(?i)licen[cs]|spdx|public domain|permission (?:is|to)|redistribut"
LICENSE_FILE = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:$|[.\-_].*)"
THRESHOLD = 0.7
_TRIGGER = re.compile(TRIGGER)
_FILE = re.compile(LICENSE_FILE)
_TERM = re.compile(r"[^\W_]+(?:[.+][0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(t.lower() for t in _TERM.findall(text))


def passages(text: str, whole: bool) -> list[Counter]:
    """Terms of every line with a trigger, of every paragraph around one, and, if asked, of the whole text."""
    found: list[Counter] = []
    paragraph: list[str] = []
    hit = False

    def close() -> None:
        if hit and len(paragraph) > 1:
            found.append(terms(" ".join(paragraph)))

    for line in text.split("\n"):
        if not line.strip():
            close()
            paragraph, hit = [], False
            continue
        paragraph.append(line)
        if _TRIGGER.search(line):
            found.append(terms(line))
            hit = True
    close()
    if whole:
        found.append(terms(text))
    return found


@dataclass
class Scanner:
    """Unit TF-IDF vectors of the templates by term; ``idf`` has their terms, others have ``rare``."""

    idf: dict[str, float]
    rare: float
    names: list[str]
    vectors: dict[str, list[tuple[int, float]]]

    @classmethod
    def of(cls, templates: Mapping[str, Sequence[str]], counts: Mapping[str, int], total: int) -> Scanner:
        names = [(name, terms(t)) for name, texts in templates.items() for t in texts]
        known = {t for _, v in names for t in v}
        idf = {t: 1 + math.log((1 + total) / (1 + counts.get(t, 0))) for t in known}
        vectors: dict[str, list[tuple[int, float]]] = {t: [] for t in known}
        for i, (_, v) in enumerate(names):
            raw = {t: n * idf[t] for t, n in v.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            for t, x in raw.items():
                vectors[t].append((i, x / norm))
        return cls(idf, 1 + math.log(1 + total), [name for name, _ in names], vectors)

    def best(self, found: list[Counter]) -> tuple[str | None, float]:
        """The template next to any passage, and its cosine; the first name of equals."""
        best: tuple[float, str | None] = (0.0, None)
        for v in found:
            square, dots = 0.0, [0.0] * len(self.names)
            for t, n in v.items():
                if t in self.idf:
                    weight = n * self.idf[t]
                    for i, x in self.vectors[t]:
                        dots[i] += weight * x
                else:
                    weight = n * self.rare
                square += weight * weight
            if not square:
                continue
            norm = math.sqrt(square)
            for name, dot in zip(self.names, dots):
                cosine = round(dot / norm, 12)
                if cosine > best[0]:
                    best = (cosine, name)
        return best[1], best[0]


def _directory(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    whole_texts: Mapping[str, Sequence[str]] = TEXTS,
) -> DataFrame:
    """``files`` without the text, with license, license_score, license_how and license_from.

    Every line of a text that has a trigger (``TRIGGER``), the paragraph around it, and in a
    licence file (by its name) the whole text, is compared with all templates by the
    cosine of TF-IDF vectors; the best one counts if it reaches ``threshold``. The whole text
    of a licence file is also compared with ``whole_texts``, of which one counts from ``WHOLE``
    (or a higher threshold) on, if no template is nearer. Inverse
    document frequencies come from the passages of all files. A file without a license of
    its own has that of the nearest directory above, or its own directory, that has a
    licence file with one; of several such files that with the best score counts, then
    the first license by name, then the first path. license_how is ``own``, ``inherited`` or null.

    Null texts and paths have no license of their own and inherit none; repeated rows stay
    repeated; columns with the names of new ones are replaced; no files give no rows.
    The terms of the templates are all that is counted on the driver.
    """
    new = ("license", "license_score", "license_how", "license_from")
    kept = [c for c in files.columns if c not in (text_col, *new)]
    text = F.col(f"`{text_col}`").cast("string")
    path = F.col(f"`{path_col}`").cast("string")
    # only texts with a trigger, and those of licence files, go to Python
    name = F.regexp_extract(path, "[^/]*$", 0)
    seen = F.when(text.rlike(TRIGGER) | F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)), text)
    rows = files.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)],
        F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)).alias("whole"),
        seen.alias("text"),
    )
    known = {t for m in (templates, whole_texts) for texts in m.values() for x in texts for t in terms(x)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for t, whole in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist()):
                for v in passages(t or "", whole) if t else ():
                    n[""] += 1
                    n.update(known & v.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    counted = rows.where("text IS NOT NULL").select("whole", "text").mapInArrow(count, "term string, n bigint")
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop("", 0)
    scanner, full = Scanner.of(templates, counts, total), Scanner.of(whole_texts, counts, total)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for t, whole in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist()):
                parts = passages(t, whole) if t else []
                found, score = scanner.best(parts)
                if whole and parts:
                    text_of, cosine = full.best(parts[-1:])
                    if cosine >= max(WHOLE, threshold) and cosine >= score:
                        found, score = text_of, cosine
                names.append(found if score >= threshold else None)
                scores.append(score if score >= threshold else None)
            columns = [*batch.columns[: len(kept) + 1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f"_{i}" for i in range(len(kept))] + ["whole", "license", "score"])

    schema = rows.drop("text").schema.add("license", "string").add("score", "double")
    found = stage(rows.mapInArrow(scan, schema), "licenses").withColumn("dir", _directory(F.col(f"_{kept.index(path_col)}").cast("string")))

    at = F.struct((-F.col("score")).alias("score"), "license", F.col(f"_{kept.index(path_col)}").cast("string").alias("path"))
    given = (
        found.where("whole AND license IS NOT NULL AND dir IS NOT NULL")
        .groupBy("dir")
        .agg(F.min(at).alias("at"))
        .select(F.col("dir").alias("above"), "at.license", (-F.col("at.score")).alias("score"), F.col("at.path").alias("path"))
    )
    # all directories above one: itself, then ever shorter beginnings, up to the top
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inherited = stage(
        found.where("dir IS NOT NULL")
        .select("dir")
        .distinct()
        .select("dir", F.explode(F.array_distinct(above)).alias("above"))
        .join(given, "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("n"), "license", "score", "path")).alias("near"))
        .select(F.col("dir").alias("to"), "near"),
        "inherited",
    )
    own = F.col("license").isNotNull()
    return found.join(inherited, F.col("dir") == F.col("to"), "left").select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)],
        F.coalesce("license", "near.license").alias("license"),
        F.coalesce("score", "near.score").alias("license_score"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("license_how"),
        F.when(own, F.col(f"_{kept.index(path_col)}").cast("string")).otherwise(F.col("near.path")).alias("license_from"),
    )
