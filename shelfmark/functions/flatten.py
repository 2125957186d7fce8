"""Flattening of nested records into (key, value) entries."""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "array<struct<key:string,value:string>>"


def _entry(key: Column, value: Column) -> Column:
    """A value with its readings as an object and as a list; both null for a leaf."""
    return F.struct(
        key.alias("key"),
        value.alias("value"),
        F.try_variant_get(value, "$", "map<string,variant>").alias("object"),
        F.try_variant_get(value, "$", "array<variant>").alias("list"),
    )


def _is_leaf(e: Column) -> Column:
    return e.object.isNull() & e.list.isNull()


def _descend(e: Column, sep: str) -> Column:
    """The children of an entry under joined keys, or the entry itself if a leaf."""

    def child(name: Column, value: Column) -> Column:
        return _entry(F.coalesce(F.concat(e.key, F.lit(sep), name), name), value)

    return F.coalesce(
        F.transform(F.map_entries(e.object), lambda c: child(c.key, c.value)),
        F.transform(e.list, lambda v, i: child(i.cast("string"), v)),
        F.array(e),
    )


def entries(value: Column, sep: str = "__", max_depth: int = 8) -> Column:
    """Entries of a VARIANT after ``max_depth`` levels; deeper ones are still nested."""
    state = F.array(_entry(F.lit(None).cast("string"), value))
    for _ in range(max_depth):
        state = F.flatten(F.transform(state, lambda e: _descend(e, sep)))
    return state


def _deeper(key: str, value, sep: str) -> list[dict]:
    """Leaves below a nested value, in order, with a work list instead of recursion."""
    out, work = [], [(key, value)]
    while work:
        name, node = work.pop()
        if isinstance(node, dict):
            work += [(f"{name}{sep}{k}", v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            work += [(f"{name}{sep}{i}", v) for i, v in reversed(list(enumerate(node)))]
        else:
            text = str(node).lower() if isinstance(node, bool) else node
            out.append({"key": name, "value": text})
    return out


def _finish(sep: str):
    """Arrow function for what lies below ``max_depth``; null (no work) for other rows."""

    @F.arrow_udf(ENTRIES)
    def finish(nested: pa.Array) -> pa.Array:
        rows = [
            None
            if row is None
            else [
                leaf
                for e in row
                # numbers stay as they are written
                for leaf in _deeper(
                    e["key"], json.loads(e["value"], parse_int=str, parse_float=str), sep
                )
            ]
            for row in nested.to_pylist()
        ]
        kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        return pa.array(rows, kind)

    return finish


def with_entries(
    df: DataFrame, value: Column, name: str, sep: str = "__", max_depth: int = 8
) -> DataFrame:
    """Add ``name``: array of (key, value text) of all leaves of a VARIANT column.

    Levels up to ``max_depth`` are unrolled column expressions. Anything deeper is
    finished by an Arrow function, so no depth is cut off.
    """
    split = df.select(
        "*",
        # outer: an inner explode infers a filter on its size, which evaluates it twice
        F.explode_outer(
            F.transform(
                F.array(entries(value, sep, max_depth)),
                lambda all_: F.struct(
                    F.transform(
                        F.filter(all_, _is_leaf),
                        lambda e: F.struct(e.key.alias("key"), e.value.cast("string").alias("value")),
                    ).alias("leaves"),
                    F.transform(
                        F.filter(all_, lambda e: ~_is_leaf(e)),
                        lambda e: F.struct(e.key.alias("key"), F.to_json(e.value).alias("value")),
                    ).alias("nested"),
                ),
            )
        ).alias("_split"),
    )
    nested = F.when(F.size("_split.nested") > 0, F.col("_split.nested"))
    return split.withColumn(
        name,
        F.concat(
            "_split.leaves", F.coalesce(_finish(sep)(nested), F.array().cast(ENTRIES))
        ),
    ).drop("_split")
