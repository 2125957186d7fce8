"""Keyword search over a stored index: the same scores as ``search``, from a part of the texts.

The index is three Parquet tables: ``texts``, every different text once, sorted by
length; ``postings``, which words are in which text, sorted by word; ``uses``, which
dataset has which text. A text without a word of the keyword can only reach a score if its
length is near that of the keyword; what a text with common words can reach follows from its
postings. Only texts that can reach the score are read and compared, each once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import keyword_sets, tokens, with_score, word_sets
from .lookup import SEARCH_KEYS, search_values
from .search import Keywords, _keyword_list


def write_search_index(catalog: DataFrame, path: str, keys: Sequence[str] = SEARCH_KEYS) -> None:
    """Write the index of the texts under ``keys`` to a new folder; it is an error if there is one.

    Rows are told apart by (pos, id). Null texts, and texts without a word, reach no
    score and are left out. A text that many datasets share is stored once.
    """
    valued, texts = search_values(catalog, keys)
    found = valued.select("pos", "id", F.explode(F.array_distinct(texts)).alias("text"))
    found = found.withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary"))))
    found.select("text_id", "pos", "id").write.parquet(f"{path}/uses")
    words = found.groupBy("text_id").agg(F.min("text").alias("text")).withColumn("_w", tokens(F.col("text")))
    words = words.where(F.size("_w") > 0).select("text_id", "text", "_w", F.length(F.array_join("_w", " ")).alias("long"))
    by_length = words.repartitionByRange("long", "text_id").sortWithinPartitions("long", "text_id")
    by_length.select("text_id", "text", "long").write.parquet(f"{path}/texts")
    stored = catalog.sparkSession.read.parquet(f"{path}/texts").withColumn("_w", tokens(F.col("text")))
    posted = stored.select(F.explode("_w").alias("token"), "text_id", "long")
    posted.repartitionByRange("token", "text_id").sortWithinPartitions("token", "text_id").write.parquet(f"{path}/postings")


def _near_length(lengths: Sequence[int], min_score: float) -> Column:
    """Can a text of this length, without any common word, reach the score with one of the keywords?"""
    share = min_score / (200 - min_score)
    return reduce(or_, [F.col("long").between(floor(y * share), ceil(y / share)) for y in lengths])


def _reach(keyword: Sequence[str]) -> Column:
    """The most that a text with the words ``_met`` in common can score with a keyword.

    ``s``, ``x`` and ``y`` are the lengths of the common words and of what is left on each side.
    """
    common = F.array_intersect("_met", F.array(*map(F.lit, keyword)))
    k, chars = F.size(common), F.length(F.array_join(common, ""))
    part = F.struct(
        (chars + k - 1).alias("s"),
        F.greatest(F.col("long") - chars - k, F.lit(0)).alias("x"),
        F.greatest(F.lit(sum(map(len, keyword)) + len(keyword) - 1) - chars - k, F.lit(0)).alias("y"),
    )

    def score(p: Column) -> Column:
        s, x, y = p.s, p.x, p.y
        return F.greatest(
            100 - 100 * (1 + x) / (2 * s + 1 + x),
            100 - 100 * (1 + y) / (2 * s + 1 + y),
            100 - 100 * F.abs(x - y) / (2 * s + 2 + x + y),
            F.when((x == 0) | (y == 0), 100.0).otherwise(0.0),
        )

    return F.when(k > 0, F.get(F.transform(F.array(part), score), F.lit(0))).otherwise(0.0)


def candidates(spark: SparkSession, path: str, words: Sequence[Sequence[str]], min_score: float) -> DataFrame:
    """(text_id, text) of the stored texts that may reach ``min_score`` with a keyword, given as its words."""
    texts = spark.read.parquet(f"{path}/texts")
    near = _near_length([sum(map(len, w)) + len(w) - 1 for w in words], min_score)
    every = sorted({w for keyword in words for w in keyword})
    met = (
        spark.read.parquet(f"{path}/postings").where(F.col("token").isin(every) & ~near)
        .groupBy("text_id").agg(F.collect_set("token").alias("_met"), F.min("long").alias("long"))
    )
    met = met.where(reduce(or_, [_reach(w) >= min_score - 1e-9 for w in words])).select("text_id")
    rest = texts.where(~near).join(met, "text_id", "left_semi")
    return texts.where(near).unionByName(rest).select("text_id", "text")


def search_indexed(spark: SparkSession, path: str, keywords: Keywords, min_score: float = 50) -> DataFrame:
    """(pos, id, score) of the datasets that reach ``min_score``, best first, ties in catalog order.

    The rows are those of ``search`` over the catalog the index was made of. A score of 0 is that of every
    other dataset, so ``min_score`` must be above it, and 100 at most. Keywords without a word reach nothing.
    """
    if not 0 < min_score <= 100:
        raise ValueError("an index holds no dataset without a hit: min_score must be above 0, and 100 at most")
    given = [w for w in _keyword_list(keywords) if w is not None]
    words = spark.range(1).select(F.array(*[tokens(F.lit(w)) for w in given]).cast("array<array<string>>")).first()[0]
    words = [w for w in words if w]
    if not words:
        return spark.read.parquet(f"{path}/uses").select("pos", "id", F.lit(0.0).alias("score")).limit(0)
    found = candidates(spark, path, words, min_score)
    scored = with_score(found, word_sets(F.array("text")), keyword_sets(given), min_score).select("text_id", "score")
    best = spark.read.parquet(f"{path}/uses").join(scored, "text_id").groupBy("pos", "id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "pos")
