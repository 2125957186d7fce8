"""Text in charsets that Spark does not read.

A file in such a charset is read as ISO-8859-1, which keeps every byte as one
character, and the string columns are then mapped to the declared charset.
"""

from __future__ import annotations

import codecs
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Charsets the readers take as they are.
NATIVE = ("utf-8", "ascii", "iso8859-1", "utf-16", "utf-16-be", "utf-16-le", "utf-32")


def reader_charset(encoding: str | None) -> tuple[str, str | None]:
    """(charset to read with, codec to map to afterwards or None)."""
    codec = codecs.lookup(encoding or "utf-8").name
    if codec in NATIVE:
        return {"ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}.get(codec, codec.upper()), None
    return "ISO-8859-1", codec


def _single_byte(codec: str) -> tuple[str, str] | None:
    """The upper half of a single-byte charset as a translation; None if it is not one."""
    upper = [bytes([b]) for b in range(0x80, 0x100)]
    try:
        ascii_same = bytes(range(0x80)).decode(codec) == bytes(range(0x80)).decode("ascii")
        decoded = [b.decode(codec, "replace") for b in upper]
    except UnicodeDecodeError:
        return None
    # a lead byte alone is undecodable; a few undefined bytes are normal in 8-bit charsets
    if not ascii_same or decoded.count("�") > 32 or any(len(d) != 1 for d in decoded):
        return None
    pairs = [(b.decode("latin-1"), d) for b, d in zip(upper, decoded) if d != "�"]
    return "".join(a for a, _ in pairs), "".join(d for _, d in pairs)


def _decoder(codec: str):
    @F.arrow_udf("string")
    def decode(raw: pa.Array) -> pa.Array:
        return pa.array(
            [None if b is None else b.decode(codec, "replace") for b in raw.to_pylist()], pa.string()
        )

    return decode


def recode(col: Column, codec: str) -> Column:
    """Text read as ISO-8859-1 -> the same bytes read as ``codec``."""
    table = _single_byte(codec)
    if table:
        return F.translate(col, *table)
    return _decoder(codec)(F.encode(col, "ISO-8859-1"))


def recode_strings(df: DataFrame, codec: str | None) -> DataFrame:
    """``recode`` on every string column, and on the column names."""
    if codec is None:
        return df
    return df.select(
        *[
            (recode(F.col(f"`{f.name}`"), codec) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
            .alias(f.name.encode("latin-1", "replace").decode(codec, "replace"))
            for f in df.schema
        ]
    )
