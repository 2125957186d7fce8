"""The operators as registered queries on the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm, toxicity
from .chat import format_chats, read_chats
from .decontaminate import find_leaks, n_hit
from .fim import fill_in_middle, restored
from .labelled import fold
from .licenses import scan_licenses
from .main_text import extract
from .minhash import edited_fingerprints
from .mixing import draws
from .pieces import encode
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .spelling import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(_table(spark, folder, "documents"))


@_query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of all documents, and which are kept."""
    return quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents; learned from four of five folds of the labels."""
    return (
        toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"), fold("doc_id", 5) != 0)
        .select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
    )


@_query
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, decoded again."""
    encoded = encode(_table(spark, folder, "documents"), keep=["doc_id"], check=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


@_query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often, and with how many words, a weighted mix takes every document."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    return draws(_table(spark, folder, "documents")).withColumn("taken", taken).drop("draws")


@_query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents; learned from three of four folds of the labels."""
    return (
        nbsvm.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"), fold("doc_id", 4) != 2)
        .select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
    )


@_query
def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return extract(_table(spark, folder, "pages").select("page_id", "url", "html"))


@_query
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts look like markup, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_chats(format_chats(rows.withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))))


@_query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """MinHash fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(_table(spark, folder, "documents")).drop("edited")


@_query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses of all documents, laid out as files of a tree by source and id.

    A directory holds ten ids of each hundred; every third document is a licence file,
    and every tenth of those one of the directory above.
    """
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 2000"))
    low = F.concat_ws("/", top, F.expr("doc_id div 200 % 10"))
    name = F.concat(F.lit("LICENSE-"), F.col("doc_id"))
    path = (
        F.when(F.col("doc_id") % 30 == 0, F.concat_ws("/", top, name))
        .when(F.col("doc_id") % 3 == 0, F.concat_ws("/", low, name))
        .otherwise(F.concat_ws("/", low, F.concat(F.col("doc_id"), F.lit(".txt"))))
    )
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


@_query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in fill-in-middle order, and rebuilt from that."""
    made = fill_in_middle(_table(spark, folder, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@_query
def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents inside windows of the benchmark, and the items that have them."""
    found = find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    hit = n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@_query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents, their near words, forms and roots."""
    return spelling_variants(_table(spark, folder, "documents"))
