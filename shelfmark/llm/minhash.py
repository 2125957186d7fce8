"""Document fingerprints: one-permutation MinHash with optimal densification, in packed low bits.

Only column expressions; one row never needs another.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import ascii_lower, let, words

BINS = 256
#: Low-order bits kept of a bin: one hexadecimal digit.
BITS = 4
SHINGLE = 5
#: Bins tried one by one for an empty bin before all others are searched.
TRIES = 12
SHIFT = 56
#: The low bits of a sentinel, the largest value of a bin.
END = (1 << SHIFT) - 1


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the ``n``-word shingles of a text; fewer words are one shingle."""

    def of(w: Column) -> Column:
        last = F.greatest(F.size(w) - n, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    return let(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)), of)


def _orders(bins: int) -> list[list[int]]:
    """For every bin, the order in which an empty one asks the others: fixed, seeded permutations."""
    rng = random.Random(20170)
    return [rng.sample([j for j in range(bins) if j != i], bins - 1) for i in range(bins)]


def _dense(v: Column, orders: Column) -> Column:
    """Low bits of every bin, an empty one (its value is the sentinel) after asking others."""
    full = F.lit(END)

    def value(x: Column, i: Column) -> Column:
        def ask(o: Column) -> Column:
            tries = [F.get(v, F.get(o, F.lit(t))) for t in range(TRIES)]
            others = F.filter(F.transform(o, lambda j: F.get(v, j)), lambda y: y.bitwiseAND(full) != full)
            return F.coalesce(*[F.when(y.bitwiseAND(full) != full, y) for y in tries], F.get(others, F.lit(0)))

        kept = F.when(x.bitwiseAND(full) != full, x).otherwise(let(F.get(orders, i), ask))
        return F.xxhash64(kept, i).bitwiseAND(F.lit((1 << BITS) - 1))

    return F.transform(v, value)


def signature(text: Column, n: int = SHINGLE) -> Column:
    """Packed signature of a text: an array of numbers with the low bits of 16 bins each.

    Every shingle is hashed once; the high bits choose its bin, and a bin keeps its
    smallest hash. Sorting the hashes together with one sentinel at the end of each bin
    brings the smallest of all bins to the front of their runs in one pass. An empty
    bin takes the value of the first bin that is not empty in an order of its own, a
    random permutation that is the same for all texts. The low bits are those of a hash
    of value and bin, so that copied values agree by chance as seldom as others. Null
    and texts without words have the signature of the empty shingle.
    """
    ends = F.expr(f"transform(sequence(0, {BINS - 1}), i -> shiftleft(cast(i - {BINS // 2} as bigint), {SHIFT}) | {END}L)")
    orders = F.from_json(F.lit(str(_orders(BINS))), "array<array<int>>")
    per = 64 // BITS

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(s, i - 1), SHIFT)))

    def pack(d: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(BINS), F.lit(per)),
            lambda at: F.aggregate(F.slice(d, at, per), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)),
        )

    hashes = F.sort_array(F.concat(shingle_hashes(text, n), ends))
    return let(let(let(hashes, least), lambda v: _dense(v, orders)), pack)


def fingerprint(packed: Column) -> Column:
    """A signature as hexadecimal digits, one for each bin."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, 0 to 1.

    Unequal values still agree in their low bits once in 2 ** BITS times; the share of
    equal bins is corrected for that.
    """
    ones = F.lit(int("1" * 16, 16)).cast("long")

    def unequal(x: Column, y: Column) -> Column:
        def bits(d: Column) -> Column:
            folded = d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3))
            return F.bit_count(folded.bitwiseAND(ones))

        return let(x.bitwiseXOR(y), bits)

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda total, x: total + x)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((BINS - differ) / BINS - chance) / (1 - chance))


def _place(id_: Column, cuts: list) -> Column:
    """How many of the descending ``cuts`` are not below the id, by bisection; all of them for null."""
    if not cuts:
        return F.lit(0)
    bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) >= id_, at + step).otherwise(at)
    )
    return F.when(id_.isNull(), F.lit(len(cuts))).otherwise(found)


def with_next(rows: DataFrame, id_col: str, cols: list[str], slices: int) -> DataFrame:
    """Add, as ``next_<col>``, the columns ``cols`` of the next row in descending order of an integer id.

    After the last row comes the first. Rows of one id, and those with a null id, which
    come last, are ordered by the values of ``cols``. The ids are cut at approximate
    quantiles into at most ``slices`` ranges, and a window runs over each range. The first
    row of a range is also dealt to the range before it, where it only closes the order;
    so each row is shuffled once, and no window sees the whole table. The quantiles and
    the largest id of every range are all that reaches the driver.
    """
    id_ = F.col(id_col).cast("long")
    shares = [i / slices for i in range(1, slices)]
    quantiles = rows.agg(F.percentile_approx(id_, shares, 10 * slices)).first()[0] if shares else None
    cuts = sorted(set(quantiles or []), reverse=True)
    place = _place(id_, cuts)
    used = rows.groupBy(place.alias("at")).agg(F.max(id_).alias("top")).collect()
    top, before = [None] * (len(cuts) + 1), [-1] * (len(cuts) + 1)
    order = sorted((r.at, r.top) for r in used)
    for k, (at, largest) in enumerate(order):
        top[at], before[at] = largest, order[k - 1][0]
    tops = F.from_json(F.lit(json.dumps(top)), "array<bigint>")
    befores = F.from_json(F.lit(json.dumps(before)), "array<int>")
    own = F.struct(place.alias("at"), F.lit(False).alias("closing"))
    head = let(place, lambda p: F.when(F.get(tops, p).eqNullSafe(id_), F.get(befores, p)))
    closing = F.struct(head.alias("at"), F.lit(True).alias("closing"))
    order_by = [F.col("_deal.closing"), id_.desc_nulls_last(), *cols]
    dealt = rows.withColumn("_deal", F.explode(F.filter(F.array(own, closing), lambda d: d["at"].isNotNull())))
    ahead = Window.partitionBy("_deal.at").orderBy(*order_by)
    return (
        dealt.withColumn("_next", F.lead(F.struct(*cols)).over(ahead))
        .where(~F.col("_deal.closing"))
        .select(*rows.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in cols])
    )


def edited_fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, slices: int | None = None
) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    Columns: the id, n_chars (code points), edited, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. The edited text ends, instead of the
    last ``floor(n_chars / 3)`` code points, in the first as many, or all, of the next
    text in descending order of id; after the last comes the first, so a single row is
    followed by itself. A null text is empty. Rows of one id are ordered by text, null
    ids come last; an empty table gives no rows; other columns are left. ``slices`` is
    the number of ranges of ids, 16 for each shuffle partition if not given.
    """
    slices = slices or 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("signature", signature(F.col("text"), n))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)
    )
    return (
        with_next(rows, "_id", ["text", "signature"], slices)
        .withColumn("edited", edited)
        .withColumn("edited_signature", signature(F.col("edited"), n))
        .select(
            F.col("_id").alias(id_col),
            F.length("text").cast("long").alias("n_chars"),
            "edited",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("signature")).alias("fingerprint"),
            fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
            likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
            likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
        )
    )
