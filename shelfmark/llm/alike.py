"""Components of texts with like word shingles: SimHash components and MinHash bands as buckets, verified by Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .components import connected_components
from .simhash import SEED, near_duplicates
from .words import texts

SHINGLE = 5
LEAST = 0.8
#: Minima of a band, and bands; a pair of Jaccard J shares a band with probability 1 - (1 - J ** ROWS) ** BANDS.
ROWS, BANDS = 5, 20
CHUNK = 1 << 12
#: How far below ``least`` the share of equal minima may be for a pair to be looked at: five deviations.
SLACK = 0.2
_rng = np.random.default_rng(SEED)
_FACTOR = _rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)
_TERM = _rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64)


def shingles(data: bytes, n: int = SHINGLE) -> set[bytes]:
    """The word n-grams of a UTF-8 text, lower case for A to Z; fewer words are one, no words none."""
    words = data.lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a: set[bytes], b: set[bytes], least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``least``; empty sets are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def sketch(data: bytes, n: int = SHINGLE) -> tuple[list[int], bytes]:
    """Hashes of the bands of a text's minima, and one byte of each minimum."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(data, n)], np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (_FACTOR * hashes[at : at + CHUNK] + _TERM).min(1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, n) for t in texts(batch, "text")]
            keys = pa.array([k for k, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), keys, pa.array([s for _, s in found], pa.binary())], ["node", "keys", "minima"])

    return run


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima of sketches, row by row."""
    return (a == b).mean(-1)


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), ROWS * BANDS)


def _close(edges: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The ``edges`` (u, v) whose sketches, from ``nodes``, have at least ``share`` of their minima equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _share(_minima(batch.column("minima_u")), _minima(batch.column("minima_v"))) >= share
                yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    ends = [nodes.select(F.col("node").alias(e), F.col("minima").alias(f"minima_{e}")) for e in "uv"]
    return edges.join(ends[1], "v").join(ends[0], "u").select("u", "v", "minima_u", "minima_v").mapInArrow(run, "u bigint, v bigint")


def _jaccard_reached(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """``alike`` of two sets of shingles as sorted hashes."""
    small, large = sorted((len(a), len(b)))
    if small < least * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def _verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``edges`` (u, v) whose ``sets`` (node, hashes) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*([np.frombuffer(h, np.uint64) for h in batch.column(c).to_pylist()] for c in ("hashes_u", "hashes_v")))
            yield batch.select(["u", "v"]).filter(pa.array([_jaccard_reached(x, y, least) for x, y in pairs], pa.bool_()))

    ends = [sets.select(F.col("node").alias(e), F.col("hashes").alias(f"hashes_{e}")) for e in "uv"]
    both = edges.join(ends[1], "v").join(ends[0], "u").select("u", "v", "hashes_u", "hashes_v")
    return stage(both.mapInArrow(run, "u bigint, v bigint"), "verified")


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """The columns of one bucket (``key``) at a time, of rows in order of their keys."""
    kept: list[list] = [[] for _ in names]
    keys: list[int] = []
    for batch in batches:
        keys += batch.column("key").to_pylist()
        for x, c in zip(kept, names):
            x += batch.column(c).to_pylist()
        start = 0
        for at in (np.flatnonzero(np.diff(np.array(keys, np.int64))) + 1).tolist():
            yield [keys[start], *(x[start:at] for x in kept)]
            start = at
        del keys[:start]
        for x in kept:
            del x[:start]
    if keys:
        yield [keys[0], *kept]


def _partners(root: np.ndarray, minima: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a bucket, those of other components with close sketches; each pair from one side at least.

    Members of the largest component ask for none, the others of it are found by theirs.
    """
    kinds, which = np.unique(root, return_inverse=True)
    for i in np.flatnonzero(which != np.bincount(which).argmax()).tolist():
        other = np.flatnonzero(root != root[i])
        near = other[_share(minima[other], minima[i]) >= share]
        if len(near):
            yield i, near


def _asking(share: float):
    """Task function: the members of each bucket that have a close member in another component; no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, root, minima in _whole_buckets(batches, ["node", "root", "minima"]):
            asking = np.zeros(len(node), bool)
            sketches = np.frombuffer(b"".join(minima), np.uint8).reshape(len(node), ROWS * BANDS)
            for i, near in _partners(np.array(root), sketches, share):
                asking[i] = True
                asking[near] = True
            out = np.array(node, np.int64)[asking]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), key), pa.int64()), pa.array(out)], ["key", "node"])

    return run


def _hashed(n: int):
    """Task function: the set of a text's shingles as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, n)], np.uint64)).tobytes() for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _forest(share: float, least: float):
    """Task function: verified links between the components of a bucket, as many as join them and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, root, minima, hashes in _whole_buckets(batches, ["node", "root", "minima", "hashes"]):
            sketches = np.frombuffer(b"".join(minima), np.uint8).reshape(len(node), ROWS * BANDS)
            sets = [np.frombuffer(h, np.uint64) for h in hashes]
            above: dict[int, int] = {}

            def top(r: int) -> int:
                while r in above:
                    r = above[r]
                return r

            links = []
            for i, near in _partners(np.array(root), sketches, share):
                for j in near.tolist():
                    a, b = top(root[i]), top(root[j])
                    if a != b and _jaccard_reached(sets[i], sets[j], least):
                        above[max(a, b)] = min(a, b)
                        links.append((max(node[i], node[j]), min(node[i], node[j])))
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def alike_components(rows: DataFrame, n: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(node, root) of every node of ``rows`` (node, text); equal texts have one node.

    Two texts are linked if the Jaccard similarity of their sets of ``n``-word shingles is at
    least ``least``. A pair is looked at if it is in one
    SimHash component (of ``n`` words) or shares one of the MinHash bands, and if at
    least ``least - SLACK`` of its minima are equal; it is checked on the sets of 64-bit
    hashes of its shingles. First every member
    of a bucket is checked against its smallest; buckets in one component then
    have nothing to add. In the others, members with a close one in another component are
    checked where they meet, until they are one component: a bucket gives fewer links than it has members, no pairs leave it, and no
    bucket is cut. Links are missed only with the bands: at 0.8
    with a probability of 0.0004. Root is the smallest node of a component.
    """
    groups = near_duplicates(rows, "node", "text", n=n).select("node", F.xxhash64("component").alias("key"))
    sketched = rows.select("node", F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches(n), "node bigint, keys array<bigint>, minima binary"
    )
    nodes = stage(sketched.groupBy("node").agg(F.first("keys").alias("keys"), F.first("minima").alias("minima")), "sketches")
    dealt = nodes.select("node", F.explode("keys").alias("key")).unionByName(groups.distinct())
    shared = stage(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "buckets")
    members = stage(dealt.join(shared.drop("n"), "key"), "members")
    unstage(shared)
    stars = members.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    close = stage(_close(stars, nodes, least - SLACK), "stars")
    # one plan at every size: texts of members are shuffled once, to be cut into shingles where they meet
    texts_ = rows.join(members.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").cast("string").alias("text"))
    sets = stage(texts_.mapInArrow(_hashed(n), "node bigint, hashes binary"), "sets")
    links = _verified(close, sets, least)
    unstage(close)
    roots = connected_components(links)
    placed = stage(
        members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed"
    )
    unstage(members)
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    sketches = nodes.select("node", "minima")
    open_ = stage(placed.join(mixed, "key").join(sketches, "node").select("key", "node", "root", "minima"), "open")
    unstage(placed)
    asking = stage(
        open_.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_asking(least - SLACK), "key bigint, node bigint"), "asking"
    )
    met = open_.join(asking, ["key", "node"]).join(sets, "node").select("key", "node", "root", "minima", "hashes")
    more = stage(
        met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_forest(least - SLACK, least), "u bigint, v bigint").distinct(), "across"
    )
    for done in (open_, asking, sets):
        unstage(done)
    found = connected_components(links.unionByName(more))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
