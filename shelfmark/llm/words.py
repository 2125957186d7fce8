"""Words and shingles, as column expressions and for Arrow batches.

A word is a run of characters other than blank, tab, line feed, vertical tab, form
feed and carriage return; these are also the bytes at which ``bytes.split`` splits.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column of a batch as UTF-8, empty for null."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text under the names ``_id`` and ``_text``; all other columns are left."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def bit_groups(bits: list[int], groups: int) -> list[list[int]]:
    """``bits`` in ``groups`` runs of nearly equal length."""
    cut = [len(bits) * g // groups for g in range(groups + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def masks(bits: list[int], groups: int, distance: int) -> list[int]:
    """The masks that leave out ``distance`` of the groups, as signed 64-bit numbers."""
    found = []
    for free in combinations(bit_groups(bits, groups), distance):
        out = {b for g in free for b in g}
        found.append(signed(sum(1 << b for b in bits if b not in out)))
    return found


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value
