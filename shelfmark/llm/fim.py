"""Fill-in-middle: texts cut into three parts and put in prefix-suffix-middle order.

A text is a sequence of units; both cuts fall between units. One match of ``(unit)*``
over the whole text keeps the end of every repetition, so the number of units and the
places of the cuts are read off it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a run of letters, or any other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Rule:
    """How often, and with which marks, texts are transformed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Of a hundred texts, so many are transformed; of those, so many begin with the suffix.
    percent: int = 90
    spm_percent: int = 20
    unit: str = UNIT

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a key, the same on every machine."""
    digest = hashlib.sha256(f"1:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(text: str, key: str, units: regex.Pattern, rule: Rule = Rule()) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of the prefix and of the middle, output)."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    first, second, kind, order = draws(key)
    if not n or kind % 100 >= rule.percent or any(m in text for m in rule.marks):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < rule.spm_percent:
        return n, "spm", a, b - a, f"{rule.suffix}{suffix}{rule.prefix}{prefix}{rule.middle}{middle}"
    return n, "psm", a, b - a, f"{rule.prefix}{prefix}{rule.suffix}{suffix}{rule.middle}{middle}"


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), rule: Rule = Rule()
) -> DataFrame:
    """(id, the columns ``keep``, n, form, prefix_chars, middle_chars, output) of every row.

    The cuts and the form depend on the id alone, so that reruns agree. A text stays
    plain if it is empty, has one of the marks in it, or is not drawn. Null texts are
    empty, a null id is the empty key. Rows are independent: repeated rows stay, an empty
    table gives no rows, other columns are left. A text is worked on as a whole, with one
    number for each of its units in memory.
    """
    kept = [id_col, *(c for c in keep if c != id_col)]
    results = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    names = [*results]
    if clash := sorted({*kept} & {*names}):
        raise ValueError(f"columns {clash} have the names of results")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # possessive: a long text needs no way back
        units = regex.compile(f"((?>{rule.unit}))*+", regex.DOTALL)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            texts = (t or "" for t in batch.column("_text").to_pylist())
            keys = (k or "" for k in batch.column("_key").to_pylist())
            rows = [cut(t, k, units, rule) for t, k in zip(texts, keys)]
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], [*kept, *names])

    columns = [F.col(f"`{c}`") for c in kept]
    rows = df.select(
        *[c.alias(f"_{i}") for i, c in enumerate(columns)],
        F.col(f"`{id_col}`").cast("string").alias("_key"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
    )
    schema = df.select(*columns).schema
    for name, kind in results.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output was made of.

    No mark ends as another begins, so a mark's first place is the one where it was put.
    """
    lead = F.when(form == "spm", rule.suffix).otherwise(rule.prefix)
    then = F.when(form == "spm", rule.prefix).otherwise(rule.suffix)
    rest = F.substring(output, F.length(lead) + F.lit(1), F.length(output))
    second = F.position(then, rest)
    one = F.substring(rest, F.lit(1), second - F.lit(1))
    tail = F.substring(rest, second + F.length(then), F.length(rest))
    third = F.position(F.lit(rule.middle), tail)
    two = F.substring(tail, F.lit(1), third - F.lit(1))
    middle = F.substring(tail, third + F.lit(len(rule.middle)), F.length(tail))
    prefix = F.when(form == "spm", two).otherwise(one)
    suffix = F.when(form == "spm", one).otherwise(two)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
