"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in column expressions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import let, two_columns, words

#: Places n-grams are hashed into; they are kept as short numbers.
PLACES = 1 << 14
#: Documents with a mean log-likelihood ratio below it are not kept, in millionths.
THRESHOLD = -150_000
SMOOTHING = 1.0
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Bits of the filter that keeps other texts out of the join with trusted ids; its size is fixed.
FILTER = 1 << 21
_FACTORS = (7919, 6425, 5373)
_HASH = 15  # hexadecimal digits of MD5


def _place(word: Column) -> Column:
    """Place of a word: its MD5's first 15 digits, as a number, modulo PLACES. Four digits tell that."""
    low = F.conv(F.substring(F.md5(word), _HASH - 3, 4), 16, 10).cast("int")
    return low.bitwiseAND(F.lit(PLACES - 1)).cast("short")


def _end(word: Column) -> Column:
    """Place of the last three characters of a word, from their code points."""
    # cut from the word each time: to hold the end in a lambda costs more than cutting it
    firsts = (F.ascii(F.substring(word, -n, n)) for n in (3, 2, 1))
    number = sum(c.cast("long") * m for c, m in zip(firsts, _FACTORS))
    return number.bitwiseAND(F.lit(PLACES - 1).cast("long")).cast("short")


def _pair(a: Column, b: Column) -> Column:
    """Place of two words that follow each other, from theirs."""
    return (a * 31 + b).bitwiseAND(F.lit(PLACES - 1))


def _places(one: Column, end: Column) -> Column:
    """Places of the n-grams of a text: its words ``one``, pairs of words, and the ends of words ``end``, as ints."""
    n = F.greatest(F.size(one) - 1, F.lit(0))
    return F.concat(one, F.zip_with(F.slice(one, F.lit(1), n), F.slice(one, F.lit(2), n), _pair), end)


def _covered(starts: Column) -> Column:
    """How many positions the windows at ascending ``starts`` cover."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(
        starts,
        begin,
        lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total")
        ),
        lambda a: a["total"],
    )


def _repeat_words(m: Column) -> Column:
    """Words in windows that are found twice or more, from the hashes of the words.

    Only a text with a repeated window sorts its windows.
    """

    def windows(h: Column) -> Column:
        last = F.greatest(F.size(h) - WINDOW, F.lit(0))
        all_ = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(all_)

    def repeated(h: Column) -> Column:
        def starts(s: Column) -> Column:
            again = F.filter(
                s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            )
            return _covered(F.sort_array(F.transform(again, lambda x: x["at"])))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, starts))

    return let(let(m, windows), repeated)


def base_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, counts and base_failed of every row, and the places of its words, _one, and of their ends, _end).

    See :func:`quality_rules` for the columns.
    """
    rows = two_columns(df, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    rows = rows.withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        # signs are counted where there are any
        F.when(F.col("_text").rlike("[#*$%&|<>]"), F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))
        .otherwise(0).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.transform("_w", lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
        F.transform("_w", _place).alias("_one"),
        F.transform("_w", _end).alias("_end"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def place_counts(base: DataFrame, trusted: DataFrame) -> DataFrame:
    """(place, r, t): how often the n-grams of all texts, and of those with an id in ``trusted``, fall on a place.

    ``base`` is that of :func:`base_rules`. Only rows whose ids may be trusted are shuffled to
    the join that decides; all others are counted where they are read.
    """
    rows = base.select("_id", "_one", "_end").withColumn("_maybe", F.coalesce(_maybe_in(trusted, F.col("_id")), F.lit(False)))
    # one plan at every size: small ids would be broadcast, large ones not
    marked = trusted.select("_id", F.lit(True).alias("_trusted")).hint("merge")
    some = rows.where("_maybe").join(marked, "_id", "left").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    others = rows.where("NOT _maybe").withColumn("_trusted", F.lit(False))

    def counted(part: DataFrame) -> DataFrame:
        # word by word instead of by _places: without a lambda all of it is compiled
        word = part.select("_one", "_end", "_trusted", F.posexplode("_one").alias("i", "one"))
        three = F.array("one", _pair(F.col("one"), F.get("_one", F.col("i") + 1)), F.get("_end", F.col("i")))
        places = word.select(F.explode(three).alias("place"), "_trusted").where("place IS NOT NULL")  # the last has no pair
        return places.groupBy("place").agg(F.count("*").alias("r"), F.count_if("_trusted").alias("t"))

    both = counted(some).unionByName(counted(others))
    return both.groupBy("place").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))


def _maybe_in(ids: DataFrame, id_: Column) -> Column:
    """False only for ids that are not in ``ids`` (column _id): a bitmap of FILTER bits, one hash."""
    place = F.xxhash64(F.col("_id").cast("string")).bitwiseAND(F.lit(FILTER - 1).cast("long"))
    words_ = ids.select(place.alias("x")).selectExpr("x div 64 AS at", "shiftleft(1L, cast(x % 64 AS int)) AS bit")
    bits = [0] * (FILTER // 64)
    for at, bit in words_.groupBy("at").agg(F.bit_or("bit")).collect():
        bits[at] = bit
    x = F.xxhash64(id_.cast("string")).bitwiseAND(F.lit(FILTER - 1).cast("long"))
    known = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")
    return F.getbit(F.get(known, F.shiftright(x, 6).cast("int")), F.pmod(x, F.lit(64)).cast("int")) == 1


def log_ratios(counts: DataFrame) -> list[int]:
    """For every place log(share in trusted / share in corpus), smoothed, in millionths.

    ``counts`` is that of :func:`place_counts`; at most one row for each place is brought to
    the driver. Without trusted n-grams all are 0.
    """
    found = [(row["place"], row["r"], row["t"]) for row in counts.collect()]  # one pass over the corpus
    all_r, all_t = (sum(x) + SMOOTHING * PLACES for x in ([r for _, r, _ in found], [t for *_, t in found]))
    out = [0] * PLACES
    if all_t > SMOOTHING * PLACES:
        for place, r, t in found:
            out[place] = round((math.log((t + SMOOTHING) / all_t) - math.log((r + SMOOTHING) / all_r)) * 1e6)
    return out


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: int = THRESHOLD,
) -> DataFrame:
    """Base counts and the verdict on every row.

    Columns: the id; n_words; word_chars (code points in words); n_symbols (characters of
    ``#*$%&|<>``); n_dup_lines (lines with a word that equal an earlier one);
    n_repeat_words (words in windows of five that are found twice or more in the text);
    base_failed (under 10 words, or over a fifth of them repeated); score, the mean over
    a text's n-grams of the log ratio of their smoothed shares among the trusted
    documents (those that a row of ``labels`` calls 1) and in the whole corpus; kept, if
    the base rules hold and the score, in millionths, is not below ``threshold``.

    N-grams are hashed words, pairs of words, and ends of words. Counts cover all
    documents; the ratios are ``PLACES`` whole numbers, so that sums are exact in any
    order. A null text has no words and fails; its score is 0. Without trusted documents
    nothing is told apart: every ratio is 0. Repeated rows and null ids are judged like
    others; an empty table gives no rows; other columns are left.
    """
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct()
    # written, so that texts are read and cut into n-grams once for counting and judging
    base = stage(base_rules(docs, id_col, text_col), "places")
    ratios = log_ratios(place_counts(base, trusted))
    weights = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")
    # as ints, so that the lambdas have nothing to cast
    ints = base.withColumns({c: F.col(c).cast("array<int>") for c in ("_one", "_end")})
    places = _places(F.col("_one"), F.col("_end"))
    total = F.aggregate("_places", F.lit(0).cast("long"), lambda a, p: a + F.get(weights, p))
    n = F.size("_places")
    return (
        ints.withColumn("_places", places)
        .withColumn("_total", total)
        .select(
            F.col("_id").alias(id_col),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.when(n > 0, F.col("_total") / (n * F.lit(1e6))).otherwise(0.0).alias("score"),
            (~F.col("base_failed") & (F.col("_total") >= n * F.lit(threshold).cast("long"))).alias("kept"),
        )
    )
