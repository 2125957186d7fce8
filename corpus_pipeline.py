"""The documents of a corpus, filtered, deduplicated, mixed and encoded in stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import alike, mixing, nbsvm, pieces, toxicity
from shelfmark.session import stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from all labels, does not call toxic."""
    scored = toxicity.toxicity(docs, _labels(spark, sf_dir), F.lit(True), keep=docs.columns)
    return scored.where("predicted = 0").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels, calls good."""
    scored = nbsvm.quality(docs, _labels(spark, sf_dir), F.lit(True), keep=docs.columns)
    return scored.where("predicted = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest id.

    Texts are linked from a Jaccard similarity of 0.8 of their sets of five-word shingles.
    Ids need not be unique: rows are told apart by id and text hash, and of rows equal
    in both one stays. Null ids come last.
    """
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    roots = alike.alike_components(rows.select(F.col("_text_hash").alias("node"), "text"))
    found = rows.select("doc_id", "_text_hash").join(roots, F.col("_text_hash") == F.col("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_hash")).alias("first")
    kept = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("_id"), F.col("first._text_hash").alias("_hash")
    )
    # null ids as a key of their own; join and choice are dealt by the same keys, so texts move once
    key = ["_none", "_key", "_text_hash"]
    keyed = lambda df, id_: df.withColumns({"_none": F.col(id_).isNull(), "_key": F.coalesce(F.col(id_).cast("string"), F.lit(""))})
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = Window.partitionBy(*key).orderBy(*others, "text")
    chosen = keyed(kept, "_id").withColumnRenamed("_hash", "_text_hash").select(key).hint("merge")
    return keyed(rows, "doc_id").join(chosen, key, "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, in the order of its shards."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, decoded again: decoded_sha256 and round_trip."""
    encoded = pieces.encode(docs, keep=["doc_id", "lang", "source"], check=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: Trained classifiers and hashes that SQL lacks; tests compare the stages with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
