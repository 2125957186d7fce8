"""Column expressions on ids, paths, tags and URIs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(col: Column) -> Column:
    """True for null and for the empty text."""
    return F.coalesce(col, F.lit("")) == ""


def _ascii_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, from the Unicode decompositions."""
    pairs = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BASE = _ascii_table()

# Letters that become more than one letter, or have no decomposition.
SPELLED = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "ı": "i",
}


def to_ascii(col: Column) -> Column:
    """Latin letters without accents; other scripts are left as they are."""
    single = {k: v for k, v in SPELLED.items() if len(v) == 1}
    out = F.translate(col, ACCENTED + "".join(single), BASE + "".join(single.values()))
    for letter, spelled in SPELLED.items():
        if len(spelled) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def slug(col: Column) -> Column:
    """Page name of an id: ascii, lower case, words joined by single dashes.

    Never null, so that a join on it needs no null filter that evaluates it again.
    """
    text = F.lower(to_ascii(F.coalesce(col, F.lit(""))))
    text = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    return F.btrim(F.regexp_replace(text, r"[^a-z0-9]+", "-"), F.lit("-"))


def extension(path: Column) -> Column:
    """Text after the last dot; the empty text if it has 10 or more characters."""
    last = F.element_at(F.split(path, r"\."), -1)
    return F.when(F.length(last) >= 10, "").otherwise(last)


def parent_uri(uri: Column) -> Column:
    """A URI without its last segment, ending in a slash."""
    return F.regexp_replace(uri, r"[^/]*$", "")


def metadata_uri(
    source: Column,
    uri: Column,
    branch: str = "main",
    descriptor: str = "dataset.json",
    legacy: bool = False,
) -> Column:
    """Where the descriptor of a dataset can be fetched; null for unknown sources.

    ``legacy`` always cuts four characters from a git URI, as if it ended in .git.
    """
    if legacy:
        repo = F.left(uri, F.greatest(F.length(uri) - 4, F.lit(0)))
    else:
        repo = F.regexp_replace(uri, r"\.git$", "")
    owner_name = F.regexp_extract(repo, r"([^/]*/)?[^/]*$", 0)
    return (
        F.when(
            source == "git",
            F.concat(
                F.lit("https://raw.githubusercontent.com/"), owner_name, F.lit(f"/{branch}/{descriptor}")
            ),
        )
        .when(source == "s3", F.concat(F.regexp_replace(uri, r"/$", ""), F.lit(f"/{descriptor}")))
    )


def list_block(items: Column, name: str) -> Column:
    """A front-matter list, one quoted item per line; empty for an empty list."""
    lines = F.array_join(
        F.transform(items, lambda t: F.concat(F.lit('\n  - "'), t, F.lit('"'))), ""
    )
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}:"), lines, F.lit("\n"))).otherwise("")
