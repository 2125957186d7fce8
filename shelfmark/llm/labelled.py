"""A bounded sample of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import texts, two_columns


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    train: Column,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    values: Sequence[int] = (0, 1),
) -> DataFrame:
    """(_id, _text, _label) of at most ``per_class`` documents of each label in ``values``.

    Only label rows for which ``train`` holds are read. Other labels and nulls are
    left; an id labelled twice counts as 1 if one of its labels is. Of each class the
    ids with the smallest hash are taken, so the choice does not depend on the order
    of the rows. The ids, at most ``2 * per_class``, are broadcast.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & F.coalesce(train, F.lit(False)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .withColumn("_at", F.xxhash64("_id"))
    )
    rows = two_columns(docs, id_col, text_col)
    known = known.join(rows.select("_id").distinct(), "_id", "left_semi")
    chosen = None
    for value in values:
        some = known.where(F.col("_label") == value).orderBy("_at", "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    return (
        rows.join(F.broadcast(chosen.select("_id", "_label")), "_id")
        .groupBy("_id")
        .agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"), F.max("_label").alias("_label"))
    )


def text_sample(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(_id, _text) of at most ``size`` different texts of the whole table, those with the smallest hash.

    Labels and ids play no part; null is the empty text. The hashes, at most ``size``, are broadcast.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_id", F.xxhash64("_text"))
    chosen = rows.select("_id").distinct().orderBy("_id").limit(size)
    return rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"))


def collect_features(sample: DataFrame, features: Callable[[bytes], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(label, features) of the sampled documents, in order of id; features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for t in texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array(found, pa.binary())], ["_id", "_label", "f"]
            )

    kind = sample.schema["_id"].dataType.simpleString()
    rows = sample.select("_id", "_label", "_text").mapInArrow(run, f"_id {kind}, _label int, f binary").toArrow()
    order = np.argsort(np.array(rows.column("_id").to_pylist()), kind="stable")
    label = rows.column("_label").to_pylist()
    found = [x.as_buffer() for chunk in rows.column("f").chunks for x in chunk]
    return [(label[i], np.frombuffer(found[i], np.int32)) for i in order]


def rows_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all documents end to end, and where each document starts (one more at the end)."""
    start = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    return (np.concatenate(docs) if docs else np.empty(0, np.int32)), start


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of ``values`` within each document."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[start[1:]] - total[start[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def score_texts(
    docs: DataFrame,
    scorer: Callable[[], Callable[[list[bytes]], np.ndarray]],
    text_col: str,
    keep: Sequence[str],
) -> DataFrame:
    """The columns ``keep`` of every row, and score; ``scorer`` makes, in every task, what turns texts into scores."""
    kept = [c for c in keep if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            found = pa.array(np.asarray(score(texts(batch, "_text")), np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], [*kept, "score"])

    columns = [F.col(f"`{c}`") for c in kept]
    named = [c.alias(f"_{i}") for i, c in enumerate(columns)]
    rows = docs.select(*named, F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, docs.select(*columns).schema.add("score", "double"))
