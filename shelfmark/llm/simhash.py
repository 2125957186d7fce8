"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components
from .words import masks, texts

SEED = 42
CHUNK = 1 << 14
#: Fingerprints of one bucket compared in memory; buckets above it are divided by further bits.
BUCKET = 4096


def simhash(data: bytes, n: int = 3) -> int:
    """SimHash of one UTF-8 text: bit set if set in over half of the shingle hashes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    shingles = max(1, len(words) - n + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, shingles, CHUNK):
        stop = min(shingles, at + CHUNK)
        spans = zip(start[at:stop].tolist(), end[np.minimum(np.arange(at, stop) + n - 1, len(words) - 1)].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<i8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, the columns ``keep``, fp) of every row: SimHash over word n-grams, lower case for A to Z, XXH64 with seed 42.

    Repeated shingles count as often as they occur. A text of fewer than ``n`` words
    is one shingle; a null text or one without words has fingerprint 0. Rows are kept
    as they are, repeated and null ids included; other columns are left.
    """
    kept = [id_col, *(c for c in keep if c not in (id_col, "fp"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash(t, n) for t in texts(batch, "_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], fp], [*kept, "fp"])

    columns = [F.col(f"`{c}`") for c in kept]
    named = [c.alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.select(*named, F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, df.select(*columns).schema.add("fp", "long"))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it counts those of the absolute value


def _forest(run: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that span the components of one bucket, each of at most ``distance`` bits."""
    left, right, rest = [], [], run
    stack: list[int] = []
    while len(rest) or stack:
        if not stack:
            stack, rest = [int(rest[0])], rest[1:]
            continue
        node = stack.pop()
        near = _bits(rest ^ np.int64(node)) <= distance
        if near.any():
            found = rest[near].tolist()
            left += [node] * len(found)
            right += found
            stack += found
            rest = rest[~near]
    return left, right


def _link(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3

        def edges(mask, key, fp) -> pa.RecordBatch:
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            start, size = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(fp)])))
            pair = start[size == 2]
            pair = pair[_bits(fp[pair] ^ fp[pair + 1]) <= distance]
            left, right = fp[pair].tolist(), fp[pair + 1].tolist()
            for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                u, v = _forest(fp[a : a + n], distance)
                left += u
                right += v
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
            kept = [np.concatenate(x) for x in zip(kept, new)]
            mask, key, fp = kept
            if len(fp) and (mask[-1] != mask[0] or key[-1] != key[0]):
                open_ = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1] + 1
                yield edges(mask[:open_], key[:open_], fp[:open_])
                kept = [x[open_:] for x in kept]
        if len(kept[0]):
            yield edges(*kept)

    return run


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between different fingerprints that connect all pairs of at most ``distance`` bits.

    ``fps`` has every fingerprint once (column fp). The 64 bits are cut into ``blocks``
    blocks; two fingerprints that differ in at most ``distance`` bits agree in some
    ``blocks - distance`` of them, so each is dealt out under every choice of that many
    blocks, and compared within the buckets. Buckets of one are dropped by count. A
    bucket of over ``bucket`` fingerprints is divided in the same way by its free bits,
    until a bucket can hold no more than 2 ** 12 different values; no pair is lost and
    no task holds more. Each bucket gives a spanning forest of its links, not all pairs.
    """
    if distance >= blocks:
        raise ValueError("more blocks than differing bits are needed")
    spark = fps.sparkSession
    bits = list(range(64))
    wide = masks(bits, blocks, distance)
    deep = []
    for m in wide:
        free = [b for b in bits if not m >> b & 1]
        groups = max(distance, -(-len(free) // max(1, 12 // max(1, distance))))
        deep.append([m | x for x in masks(free, groups, distance)])
    keys = fps.select(
        F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for m in wide])).alias("k"),
        "fp",
    ).select("k.mask", "k.key", "fp")
    shared = stage(keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    finer = spark.createDataFrame(list(zip(wide, deep)), "mask bigint, finer array<bigint>")
    rows = keys.join(shared, ["mask", "key"])
    large = (
        rows.where(F.col("n") > bucket)
        .join(F.broadcast(finer), "mask")  # one row per choice of blocks
        .select(F.explode("finer").alias("mask"), "fp")
        .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    )
    dealt = rows.where(F.col("n") <= bucket).select("mask", "key", "fp").unionByName(large)
    return (
        dealt.repartition("mask", "key")
        .sortWithinPartitions("mask", "key", "fp")
        .mapInArrow(_link(distance), "u bigint, v bigint")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    distance: int = 3,
    blocks: int = 6,
    bucket: int = BUCKET,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, fingerprint, component_id, component, the columns ``keep``) of every row.

    ``component_id`` is the smallest id among all rows reachable over links of at most
    ``distance`` differing bits, the row itself included. Equal fingerprints (exact
    copies, all texts without words) are one node, however many rows have them. Null
    ids are no candidates for it; a component with null ids only has null. ``component`` is
    the smallest fingerprint of the component, which no other has. Repeated
    rows stay repeated, an empty table gives no rows, other columns are left.
    """
    docs = stage(fingerprints(df, id_col, text_col, n, keep), "simhash")
    nodes = stage(docs.groupBy("fp").agg(F.min(id_col).alias("_least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), distance, blocks, bucket))
    placed = stage(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "placed",
    )
    least = stage(placed.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    named = stage(placed.join(least, "root").select("fp", "component_id", "root"), "components")
    return docs.join(named, "fp").select(
        id_col,
        _hex(F.col("fp")).alias("fingerprint"),
        "component_id",
        _hex(F.col("root")).alias("component"),
        *[c for c in keep if c != id_col],
    )


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
