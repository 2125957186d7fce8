"""Keyword search over a catalog.

A search is one pass over the catalog: values and keywords meet inside the row
(literal keywords, no join), the best score is reduced inside the row (no group-by),
and only the final ranking moves data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import keyword_sets, with_score, word_sets
from .lookup import SEARCH_KEYS, search_values

Keywords = str | Sequence[str | None] | None


def _keyword_list(keywords: Keywords) -> list[str | None]:
    if keywords is None:
        return []
    return [keywords] if isinstance(keywords, str) else list(keywords)


def search_score(
    catalog: DataFrame,
    keywords: Keywords,
    keys: Sequence[str] | None = None,
    normalize: bool = True,
    min_score: float | None = None,
) -> DataFrame:
    """The catalog with ``score``: best similarity of any keyword and any text.

    Datasets without texts, and all datasets if there is no keyword, score 0. With
    ``min_score`` only rows that reach it are returned, and less is computed.
    """
    words = _keyword_list(keywords)
    if not words:
        scored = catalog.withColumn("score", F.lit(0.0))
        return scored if min_score is None else scored.filter(F.col("score") >= min_score)
    columns = catalog.columns
    catalog, texts = search_values(catalog, SEARCH_KEYS if keys is None else keys)
    scored = with_score(
        catalog, word_sets(texts, normalize), keyword_sets(words, normalize), min_score
    )
    return scored.select(*columns, "score")


def search(
    catalog: DataFrame,
    keywords: Keywords,
    min_score: float = 50,
    keys: Sequence[str] | None = None,
    limit: int | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Datasets that reach ``min_score``, best first, ties in catalog order.

    A global sort reads its input twice, first to sample the range bounds. The hits,
    few against the catalog, are therefore exchanged once before the sort, so that
    the catalog is scored only once. A top-k needs no range sort.
    """
    found = search_score(catalog, keywords, keys, normalize, min_score)
    if limit is None:
        return found.repartition("pos").orderBy(F.desc("score"), "pos")
    return found.orderBy(F.desc("score"), "pos").limit(limit)


def result_count(results: DataFrame) -> DataFrame:
    """Number of results, as one row."""
    return results.agg(F.count("*").alias("n_results"))
