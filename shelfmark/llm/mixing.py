"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .words import WORD

#: Blocks a source is cut into; a block is a random share of its documents.
BLOCKS = 4096
REPEATS = 3
#: Sources are summed up on the driver, one row each; more are refused.
MAX_SOURCES = 10_000


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], repeats: int = REPEATS) -> list[Source]:
    """Sources by code point, null last, with their weights, repeated in turn, and targets.

    The targets share the sum of all sizes by weight. One that is above ``repeats`` times
    its source's size stops there, and what is over is shared by the others in the same
    way, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    found = [Source(n, int(z), float(weights[i % len(weights)]), 0.0) for i, (n, z) in enumerate(order)]
    total = float(sum(s.size for s in found))
    open_ = found
    while open_:
        weight = sum(s.weight for s in open_)
        full = [s for s in open_ if total * s.weight / weight > repeats * s.size]
        if not full:
            for s in open_:
                s.target = total * s.weight / weight
            break
        for s in full:
            s.target = float(repeats * s.size)
        total -= sum(s.target for s in full)
        open_ = [s for s in open_ if s not in full]
    return found


def splitting_tree(quotas: Sequence[int], shards: int, seed: int = 0) -> np.ndarray:
    """Draws of every source (rows) that go to every shard (columns).

    A node holds the draws of its shards and gives its left half of them a share drawn
    from the multivariate hypergeometric distribution, as if all its draws had been
    shuffled and dealt; the rest goes right. Row sums are the quotas, exactly.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)
    stack = [(0, shards, np.array(quotas, np.int64))]
    while stack:
        first, end, q = stack.pop()
        if end - first == 1:
            out[:, first] = q
            continue
        middle = (first + end) // 2
        take = int(q.sum()) * (middle - first) // (end - first)
        left = np.zeros_like(q)
        rest = int(q.sum())
        for i, n in enumerate(q.tolist()):  # its marginals, one source after the other
            left[i] = _hypergeometric(rng, n, rest - n, take)
            take -= left[i]
            rest -= n
        stack += [(middle, end, q - left), (first, middle, left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    return int(rng.hypergeometric(good, bad, drawn)) if good and drawn else 0


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    """``docs`` with _source, _size (words), _hash (of seed and id) and _block."""
    hash_ = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    return (
        docs.withColumn("_source", F.col(source_col).cast("string"))
        .withColumn("_size", n_words(F.col(text_col).cast("string")))
        .withColumn("_hash", hash_)
        .withColumn("_block", F.pmod(F.shiftright("_hash", 12), F.lit(blocks)).cast("int"))
    )


def _coprime(quota: int, rng: np.random.Generator) -> int:
    while True:
        a = int(rng.integers(1, max(2, quota)))
        if math.gcd(a, quota) == 1:
            return a


def plan_mix(
    sized: DataFrame, weights: Sequence[float], repeats: int, blocks: int, shards: int, seed: int
) -> DataFrame:
    """One row for every source: its size and target, and which draws it gives to which shard.

    ``sized`` has the columns _source, _size, _block and _hash. A draw is one block in one
    pass over its source. With a target of ``t`` words the first ``t // size`` passes take
    every block. The last pass takes the blocks before ``last``, and of that one the
    documents whose hash is below ``edge``; a document at ``edge`` gives ``part`` words,
    which makes the target exact. The quota of a source is the number of its draws; the
    splitting tree deals it out, and ``until`` has the running sums over the shards.
    Sums of blocks, at most ``blocks`` for a source, and of the documents of one block
    run in windows; a row for each source comes to the driver.
    """
    spark = sized.sparkSession
    block = stage(sized.groupBy("_source", "_block").agg(F.sum("_size").alias("_size")), "blocks")
    rows = block.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = targets([(r["_source"], r["n"]) for r in rows], weights, repeats)
    words = [min(round(s.target), repeats * s.size) for s in found]
    rest = spark.createDataFrame(
        [(s.name, w % s.size if s.size else 0) for s, w in zip(found, words)], "name string, rest bigint"
    )

    def cut(df: DataFrame, key: str) -> DataFrame:
        """For every source the ``key`` in which ``rest`` falls, and what of it is left there."""
        before = Window.partitionBy("_source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return (
            df.withColumn("before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("_size")))
            .withColumn("rest", F.col("rest") - F.col("before"))
        )

    known = F.col("_source").eqNullSafe(F.col("name"))
    last = stage(cut(block.join(F.broadcast(rest), known), "_block").select("name", "_block", "rest"), "last")
    inside = (
        sized.join(F.broadcast(last.withColumnRenamed("_block", "last")), known & (F.col("_block") == F.col("last")))
        .groupBy("_source", "last", "rest", "_hash")
        .agg(F.sum("_size").alias("_size"), F.count("*").alias("n"))
    )
    edges = {r["_source"]: r for r in cut(inside, "_hash").collect()}

    rng = np.random.default_rng(seed)
    quotas = [
        (w // s.size if s.size else 0) * blocks + (edges[s.name]["last"] + 1 if s.name in edges else 0)
        for s, w in zip(found, words)
    ]
    until = np.cumsum(splitting_tree(quotas, shards, seed), axis=1)
    out = []
    for s, w, quota, u in zip(found, words, quotas, until.tolist()):
        edge = edges.get(s.name)
        at = (edge["last"], edge["_hash"], edge["rest"] // edge["n"]) if edge else (-1, 0, 0)
        step = _coprime(quota, rng) if quota else 1
        out.append((s.name, s.size, s.target, w // s.size if s.size else 0, *at, quota, step, u))
    return spark.createDataFrame(
        out,
        "_name string, source_size bigint, target double, _passes int, _last int, _edge bigint, _part bigint,"
        " _quota bigint, _step bigint, _until array<bigint>",
    )


def draws(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    repeats: int = REPEATS,
    blocks: int = BLOCKS,
    shards: int = 64,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, draws) of every row.

    ``draws`` has, for every time the mix takes the document, the pass, the shard, the
    place in the shard's order, and the words taken. Only the one document at which a
    source reaches its target is taken in part. Sources by code point, null last, have
    the ``weights`` in turn; none is taken more than ``repeats`` times. Size counts
    words; a null text has none. Everything follows from ids, sizes and the seed, so
    reruns agree. Rows of one id are taken alike; null ids are one id. An empty table
    gives no rows; other columns are left.
    """
    columns = [F.col(c).alias(c) for c in dict.fromkeys((id_col, text_col, source_col))]
    sized = stage(
        _sized(docs.select(*columns), id_col, text_col, source_col, blocks, seed).select(
            F.col(id_col).alias("_id"), "_source", "_size", "_hash", "_block"
        ),
        "sized",
    )
    plan = plan_mix(sized, weights, repeats, blocks, shards, seed)
    return _drawn(sized, plan, repeats, blocks).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_draws").alias("draws")
    )


def _drawn(sized: DataFrame, plan: DataFrame, repeats: int, blocks: int) -> DataFrame:
    joined = sized.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_name")))  # a row for each source
    before = (F.col("_block") < F.col("_last")) | ((F.col("_block") == F.col("_last")) & (F.col("_hash") < F.col("_edge")))
    at = (F.col("_block") == F.col("_last")) & (F.col("_hash") == F.col("_edge"))
    whole = F.col("_passes") + before.cast("int")
    part = F.when(at, F.col("_part")).otherwise(F.lit(0))

    def draw(k: Column) -> Column:
        slot = F.pmod((k * blocks + F.col("_block")) * F.col("_step"), F.col("_quota"))
        return F.struct(
            k.alias("pass"),
            F.size(F.filter("_until", lambda u: u <= slot)).alias("shard"),
            F.xxhash64("_hash", k).alias("place"),
            F.when(k < whole, F.col("_size")).otherwise(part).alias("words"),
        )

    passes = F.array(*[F.lit(k) for k in range(repeats + 1)])
    taken = F.filter(passes, lambda k: (k < whole) | ((k == whole) & (part > 0)))
    return joined.withColumn("_draws", F.transform(taken, draw))


def first_words(text: Column, n: Column) -> Column:
    """A text up to its ``n``-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    repeats: int = REPEATS,
    blocks: int = BLOCKS,
    shards: int = 64,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed documents: the columns of ``docs``, and mix_shard, mix_place and mix_pass.

    A document is there once for every draw (see :func:`draws`); the one that completes a
    source is cut after its last word taken. Shards are dealt to partitions, and every
    shard is in the order of mix_place.
    """
    sized = _sized(docs, id_col, text_col, source_col, blocks, seed)
    small = stage(sized.select("_source", "_size", "_hash", "_block"), "sized")
    plan = plan_mix(small, weights, repeats, blocks, shards, seed)
    whole = F.col("_draw.words") == F.col("_size")
    text = F.when(whole, F.col(text_col)).otherwise(first_words(F.col(text_col).cast("string"), F.col("_draw.words")))
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return (
        _drawn(sized, plan, repeats, blocks)
        .withColumn("_draw", F.explode("_draws"))
        .select(
            *kept,
            F.col("_draw.shard").alias("mix_shard"),
            F.col("_draw.place").alias("mix_place"),
            F.col("_draw.pass").alias("mix_pass"),
        )
        .repartition("mix_shard")
        .sortWithinPartitions("mix_shard", "mix_place")
    )
