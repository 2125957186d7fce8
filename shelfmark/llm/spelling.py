"""Spelling variants: words one edit apart, by letter-count Gram matrices over blocks of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One occurrence in so many loses a letter, chosen by a hash of the document's id and the word.
NOISE = 97
LETTERS, OCCURRENCES = 5, 3
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of a bucket that are compared in memory; larger buckets are divided further.
BUCKET = 4096
#: Rows of one Gram matrix, and cells (words times letters) of one block.
ROWS, CELLS = 384, 1 << 22
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# the places of letters in a count: a to z, then the 64 from U+00C0; all else (padding) is not counted
_KINDS = 26 + 64
_PLACE = np.full(256, _KINDS)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = np.arange(26, _KINDS)
_KEY = ["size", "lo", "hi", "fixed"]


def noisy(word: str, start: int) -> str:
    """The word as it counts: without one letter if its hash, which goes on from ``start``, says so."""
    h = zlib.crc32(word.encode(), start)
    if h % NOISE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                start = zlib.crc32(f"{key or ''}:".encode())
                for found, n in Counter(RUN.findall(text or "")).items():
                    if len(found) >= least:
                        word = noisy(found.lower() if found.isascii() else found.translate(_LOWER), start)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > COUNTED:
                    yield rows()
        if total:
            yield rows()

    return run


def vocabulary(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES
) -> DataFrame:
    """(word, n): words of at least ``letters`` code points and ``occurrences`` occurrences in all texts.

    Words are runs of A to Z, a to z and U+00C0 to U+00FF, lower case for A to Z, with a
    letter less where ``noisy`` says so. Null texts have none, a null id is the empty string.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    counted = rows.mapInArrow(_counted(letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _entry(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """A word in the bucket of shorter words of ``size`` letters whose letters from lo to hi may differ."""
    m, after = F.length(word), size - hi
    fixed = F.concat(F.substring(word, F.lit(1), lo), F.substring(word, m - after + F.lit(1), after))
    free = F.substring(word, lo + F.lit(1), m - lo - after)
    return F.struct(size.alias("size"), lo.alias("lo"), hi.alias("hi"), fixed.alias("fixed"), free.alias("free"))


def _dealt(words: DataFrame) -> DataFrame:
    """(size, lo, hi, fixed, free, n): every word under three cuts, as the shorter and as the longer of a pair.

    Two words one edit apart agree before and after the third of the shorter one that
    has the edit in it; those two parts and the third are the bucket.
    """
    m = F.length("word")
    entries = [
        _entry(F.col("word"), size, F.floor(size * p / 3).cast("int"), F.floor(size * (p + 1) / 3).cast("int"))
        for size in (m, m - F.lit(1))
        for p in range(3)
    ]
    return words.select(F.explode(F.array(*entries)).alias("e"), "n").select("e.*", "n")


def _divided(rows: DataFrame) -> DataFrame:
    """The rows of large buckets again, their free letters cut into pairs: such a bucket is bounded by the alphabet."""
    word = F.concat(F.substring("fixed", F.lit(1), F.col("lo")), "free", F.substring("fixed", F.col("lo") + F.lit(1), F.length("fixed")))
    size, lo, hi = F.col("size"), F.col("lo"), F.col("hi")
    starts = F.sequence(lo, F.greatest(lo, hi - F.lit(1)), F.lit(2))
    finer = F.transform(starts, lambda a: _entry(F.col("_word"), size, a, F.least(a + F.lit(2), hi)))
    return rows.withColumn("_word", word).select(F.explode(finer).alias("e"), "n").select("e.*", "n")


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row of code points, in numbers whose products are exact."""
    rows, kind = len(codes), np.float32 if codes.shape[1] < 4000 else np.float64
    places = _PLACE[np.minimum(codes, 255)] + (np.arange(rows) * (_KINDS + 1))[:, None]
    return np.bincount(places.ravel(), minlength=rows * (_KINDS + 1)).reshape(rows, -1)[:, :_KINDS].astype(kind)


def near_pairs(codes: np.ndarray, bucket: np.ndarray, long: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one bucket that are one edit apart, each in one bucket only.

    ``codes`` are free letters, padded by zeros; ``long`` marks rows with a letter more than
    the bucket's size, ``last`` those of buckets that reach the end of their words. The
    product of the letter counts gives all squared distances of a block: 2 after a replaced
    letter, 1 after an inserted one; what is left is compared letter by letter. An insertion
    belongs to the bucket of the last place where the letter may have been put.
    """
    rows = len(codes)
    codes = np.concatenate([codes, np.zeros((rows, 1), codes.dtype)], axis=1)
    wide = codes.shape[1]
    tile = max(1, min(ROWS, CELLS // wide))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    counts = [letter_counts(codes[a : a + tile]) for a in range(0, rows, tile)]
    squares = [(c * c).sum(1) for c in counts]
    cols = np.arange(wide - 1)
    for a, (ca, sa) in enumerate(zip(counts, squares)):
        for b in range(a, len(counts)):
            far = sa[:, None] + squares[b][None, :] - 2 * (ca @ counts[b].T)
            at, bt = slice(a * tile, a * tile + len(ca)), slice(b * tile, b * tile + len(counts[b]))
            ok = (far <= 2) & (bucket[at, None] == bucket[None, bt]) & ~(long[at, None] & long[None, bt])
            i, j = np.nonzero(ok)
            i, j = i + a * tile, j + b * tile
            i, j = (x[i < j] for x in (i, j)) if a == b else (i, j)
            for lo in range(0, len(i), tile):
                u, v = i[lo : lo + tile], j[lo : lo + tile]
                same = long[u] == long[v]
                x, y = u[same], v[same]
                good = (codes[x] != codes[y]).sum(1) == 1
                left.append(x[good])
                right.append(y[good])
                x, y = u[~same], v[~same]
                s, t = np.where(long[x], y, x), np.where(long[x], x, y)
                first = (codes[s] != codes[t]).argmax(1)  # the padding of the shorter one differs at the latest
                moved = np.take_along_axis(codes[t], cols + (cols >= first[:, None]), 1)
                inside = (codes[s, first] != 0) | last[s]
                good = (moved == codes[s][:, :-1]).all(1) & inside
                left.append(s[good])
                right.append(t[good])
    return np.concatenate(left), np.concatenate(right)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word of a bucket with near words there: how many, and the most frequent of them."""
    names = ["word", "n_near", "form_n", "form"]
    kept: list[list] = [[] for _ in range(6)]

    def block(rows: list[list], bucket: np.ndarray) -> pa.RecordBatch:
        size, lo, hi, fixed, free, n = rows
        wide = max(map(len, free), default=0)
        codes = np.array(free, f"<U{max(1, wide)}").view("<u4").reshape(len(free), -1)
        size, lo_, hi_ = (np.array(x) for x in (size, lo, hi))
        long = np.array(list(map(len, free))) > hi_ - lo_
        i, j = near_pairs(codes, bucket, long, hi_ == size)
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        words = {k: fixed[k][: lo[k]] + free[k] + fixed[k][lo[k] :] for k in set(one.tolist())}
        rank = np.zeros(len(free), np.int64)
        for place, k in enumerate(sorted(words, key=words.__getitem__)):
            rank[k] = place
        often = np.array(n, np.int64)
        order = np.lexsort((rank[other], -often[other], one))
        one, other = one[order], other[order]
        at = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.empty(0, np.int64)
        near = np.diff(np.concatenate([at, [len(one)]]))
        own, best = one[at].tolist(), other[at].tolist()
        out = [
            pa.array([words[k] for k in own], pa.string()), pa.array(near, pa.int64()),
            pa.array(often[best] if best else [], pa.int64()), pa.array([words[k] for k in best], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(out, names)

    def blocks(rows: list[list], all_: bool) -> Iterator[pa.RecordBatch]:
        """Whole buckets in blocks; without ``all_`` the last bucket stays for the next batch."""
        keys = list(zip(*rows[:4]))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
        ends = [*starts[1:], len(keys)]
        if not all_:
            starts, ends = starts[:-1], ends[:-1]
        first, number, wide = 0, [], 1
        for a, b in zip(starts, ends):
            width = max(map(len, rows[4][a:b]))
            if number and (b - first > ROWS or (b - first) * max(wide, width) > CELLS):
                yield block([x[first:a] for x in rows], np.array(number))
                first, number, wide = a, [], 1
            wide = max(wide, width)
            number += [a] * (b - a)
        done = ends[-1] if ends else 0
        if number:
            yield block([x[first:done] for x in rows], np.array(number))
        for x in rows:
            del x[:done]

    for batch in batches:
        for x, new in zip(kept, batch.columns):
            x += new.to_pylist()
        if kept[0]:
            yield from blocks(kept, False)
    if kept[0]:
        yield from blocks(kept, True)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): forms followed to the last, twice as far in each round.

    A form is at least twice as frequent as its word, so that there are no circles and a
    path has no more steps than the largest count has bits.
    """
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stage(roots.join(onward, "root", "left").select("word", "root", "_next"), "roots")
        if further.where("_next IS NOT NULL").isEmpty():
            return roots
        roots = further.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
    bucket: int = BUCKET,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are near if they differ by one inserted, deleted or replaced code point. The form
    of a word is its most frequent near word (ties: the first in code-point order), if
    that is at least twice as frequent as the word; root follows forms to the last, and
    is the word itself without one. An empty table gives no rows; repeated documents count
    again; columns other than id and text are left. Words are of any length.

    Near words are looked for in buckets that fix all but a third of the letters (see
    ``_dealt``); buckets of over ``bucket`` words are divided until two letters are free.
    A bucket gives a row for each word that has near words in it, never the pairs.
    """
    words = stage(vocabulary(df, id_col, text_col, letters, occurrences), "words")
    rows = _dealt(words)
    large = stage(rows.groupBy(*_KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > bucket), "buckets")
    if not large.isEmpty():
        large = large.drop("_n")
        rows = rows.join(large, _KEY, "left_anti").unionByName(_divided(rows.join(large, _KEY, "left_semi")))
    same = Window.partitionBy(*_KEY)
    shared = rows.repartition(*_KEY).withColumn("_n", F.count("*").over(same)).where("_n > 1").drop("_n")
    near = shared.select("size", "lo", "hi", "fixed", "free", "n").mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))).alias("_best")
    found = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    often = -F.col("_best.minus")
    named = words.join(found, "word", "left").select(
        "word",
        F.when(often >= 2 * F.col("n"), F.col("_best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often >= 2 * F.col("n"), often).alias("form_n"),
    )
    named = stage(named, "forms")
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
