"""Joins of a large table with keys, safe against hot keys.

Semi and anti joins are plain: adaptive execution splits a hot key of the left side.
It cannot in an existence join, or where the right side is an aggregate; there the keys
are salted, or written first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SALT = 16


def flagged(left: DataFrame, keys: DataFrame, key: str, name: str, spread: Sequence[str], salt: int = SALT) -> DataFrame:
    """Add ``name``: does the row's key occur in ``keys``? Null keys do not.

    One existence join, for which the left side is read once. The rows of a key are
    dealt to ``salt`` tasks by the columns ``spread``, and the different keys are repeated as
    often. Spark's size estimate does not see the repeats, so the keys are never broadcast.
    """
    # the key under a name of its own, as the subquery would find its own column of that name first
    dealt = left.withColumns({"_asked": F.col(key), "_salt": F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int")})
    there = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_there")).distinct()
    copies = there.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    same = (F.col("_there") == F.col("_asked").outer()) & (F.col("_dealt") == F.col("_salt").outer())
    return dealt.select(*left.columns, copies.where(same).exists().alias(name))


def known(left: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: does the row's key occur in ``keys``? Null keys do not.

    For a left side of mostly different keys, where :func:`flagged` would repeat all keys for
    the sake of a few hot ones. The different keys are written once, so that the join has no
    aggregate on its right side and adaptive execution splits a hot key of its left side. They
    are not broadcast: their size in a file says little of their size in memory.
    """
    there = stage(keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_there")).distinct(), "keys").hint("merge")
    joined = left.withColumn("_asked", F.col(key)).join(there, F.col("_asked") == F.col("_there"), "left")
    return joined.select(*left.columns, F.col("_there").isNotNull().alias(name))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], salt: int = SALT) -> DataFrame:
    """Left join with an aggregate that is unique on ``key``.

    The rows of a key are dealt to ``salt`` tasks by the columns ``spread``, and the
    aggregate, which is small against the left side, is repeated as often; it is not
    broadcast, as Spark's size estimate does not see the repeats.
    """
    payload = [c for c in right.columns if c != key]
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    return dealt.join(copies, [key, "_salt"], "left").select(*left.columns, *payload)


def row_key(df: DataFrame) -> list[str]:
    """The columns that tell the rows of a catalog apart."""
    return [c for c in ("id", "pos", "catalog") if c in df.columns]
