"""Token-set similarity of texts, 0..100.

Everything but the longest common subsequence (LCS) is a column expression. Each
pair first gets a closed-form lower and upper bound of its score; only pairs whose
upper bound can still change the result of their row go to the one Arrow function
that computes an LCS.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Arrow function travels by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What is not part of a word, and what separates words.
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"

# Remainders up to this total length get an edit distance before an LCS.
SHORT = 256


def tokens(text: Column, normalize: bool = True) -> Column:
    """Distinct words of a text; an empty array for null.

    No higher-order function is used, so a literal text folds to a constant.
    """
    if normalize:
        words = F.split(F.lower(F.regexp_replace(text, NOT_WORD, " ")), " ")
    else:
        words = F.split(text, SPACE)
    return F.coalesce(F.array_remove(F.array_distinct(words), ""), F.array().cast("array<string>"))


def _word_set(words: Column) -> Column:
    return F.struct(
        words.alias("words"),
        F.size(words).alias("n"),
        F.length(F.array_join(words, "")).alias("chars"),
    )


def word_sets(texts: Column, normalize: bool = True) -> Column:
    """Array of texts -> array of (words, number of words, number of characters)."""
    return F.transform(F.transform(texts, lambda t: tokens(t, normalize)), _word_set)


def keyword_sets(keywords: Sequence[str | None], normalize: bool = True) -> Column:
    """The same for literal keywords."""
    return F.array(
        *[_word_set(tokens(F.lit(k).cast("string"), normalize)) for k in keywords]
    )


# The steps below are SQL over arrays. Each is a lambda over the result of the step
# before, so nothing is evaluated twice; the pairs live inside one row and are never
# shuffled. ``_a`` and ``_b`` are arrays of word sets.

# all pairs, with their common words; a long text is hashed once against all words of
# ``_b``, not once per keyword
_PAIRS = """
flatten(transform(
  transform(_a, v -> named_struct('v', v, 'met', array_intersect(v.words, flatten(transform(_b, k -> k.words))))),
  m -> transform(_b, k -> named_struct('v', m.v, 'k', k, 'common', array_intersect(m.met, k.words)))))
"""

# number and total length of common and remaining words
_COUNTED = """
named_struct('a', p.v.words, 'b', p.k.words, 'empty', p.v.n = 0 OR p.k.n = 0,
  'n', size(p.common), 'c', length(array_join(p.common, '')),
  'na', p.v.n - size(p.common), 'nb', p.k.n - size(p.common), 'ca', p.v.chars, 'cb', p.k.chars)
"""

# lengths when joined by single blanks: common part s, remainders x and y
_MEASURED = """
named_struct('a', p.a, 'b', p.b, 'empty', p.empty, 'e', if(p.n > 0, 1, 0),
  's', if(p.n > 0, p.c + p.n - 1, 0),
  'x', if(p.na > 0, p.ca - p.c + p.na - 1, 0),
  'y', if(p.nb > 0, p.cb - p.c + p.nb - 1, 0))
"""

# lower and upper bound of the score; equal where no LCS is needed
_BOUNDED = """
named_struct('a', p.a, 'b', p.b,
  'lo', CASE WHEN p.empty OR p.s = 0 THEN 0D
             WHEN p.x = 0 OR p.y = 0 THEN 100D
             ELSE greatest(100 - 100 * (p.e + p.x) / (2 * p.s + p.e + p.x),
                           100 - 100 * (p.e + p.y) / (2 * p.s + p.e + p.y)) END,
  'hi', CASE WHEN p.empty THEN 0D
             WHEN p.s > 0 AND (p.x = 0 OR p.y = 0) THEN 100D
             ELSE 100 - 100 * abs(p.x - p.y) / (2 * p.s + 2 * p.e + p.x + p.y) END,
  'rest', p.x + p.y, 'diff', abs(p.x - p.y), 'total', 2 * p.s + 2 * p.e + p.x + p.y)
"""

# remaining words of one side, as the text that is compared
_X = "array_join(sort_array(array_except(p.a, p.b)), ' ')"
_Y = "array_join(sort_array(array_except(p.b, p.a)), ' ')"

# Closer bounds of a short pair, from the edit distance v. Of the v edits at most
# v - diff are substitutions, each worth two of the insertions and deletions that the
# score counts (d): v <= d <= 2v - diff.
_TEXTS = f"named_struct('p', p, 'x', if(p.rest <= {SHORT}, {_X}, NULL), 'y', if(p.rest <= {SHORT}, {_Y}, NULL))"
_EDITED = "named_struct('p', q.p, 'x', q.x, 'y', q.y, 'v', levenshtein(q.x, q.y))"
_TIGHTENED = """
named_struct('a', q.p.a, 'b', q.p.b, 'x', q.x, 'y', q.y,
  'lo', coalesce(100 - 100 * (2 * q.v - q.p.diff) / q.p.total, 0D),
  'hi', least(q.p.hi, 100 - 100 * q.v / q.p.total),
  'rest', q.p.rest, 'total', q.p.total)
"""

_OPEN = f"""
named_struct('hi', p.hi, 'rest', p.rest, 'total', p.total, 'x', coalesce(p.x, {_X}), 'y', coalesce(p.y, {_Y}))
"""


def _score_plan(min_score: float | None) -> Column:
    """An array of one struct(lo, todo) over all pairs of ``_a`` and ``_b``.

    ``lo`` is a lower bound of the best score, ``todo`` holds the pairs whose LCS may
    raise it (and reach ``min_score``). Long texts rarely stay in ``todo``, so they are
    not sent to Python.
    """
    may_win = "p -> p.hi > s.lo" + ("" if min_score is None else f" AND p.hi >= {float(min_score)!r}D")
    bounded = f"""
      transform(transform(transform({_PAIRS}, p -> {_COUNTED}), p -> {_MEASURED}), p -> {_BOUNDED})"""
    steps = [
        "named_struct('lo', greatest(s.lo, array_max(transform(s.pairs, p -> p.lo))), 'pairs', s.pairs)",
        f"""named_struct('lo', s.lo, 'pairs',
              transform(transform(transform(filter(s.pairs, {may_win}), p -> {_TEXTS}), q -> {_EDITED}), q -> {_TIGHTENED}))""",
        "named_struct('lo', greatest(s.lo, array_max(transform(s.pairs, p -> p.lo))), 'pairs', s.pairs)",
        f"named_struct('lo', s.lo, 'todo', transform(filter(s.pairs, {may_win}), p -> {_OPEN}))",
    ]
    state = f"array(named_struct('lo', 0D, 'pairs', {bounded}))"
    for step in steps:
        state = f"transform({state}, s -> {step})"
    return F.expr(state)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & masks.get(char, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.DoubleType())
def _best_open(todo: pa.Array) -> pa.Array:
    """Best exact score among the open pairs of each row; 0 if there are none."""
    pairs = todo.flatten()
    hi, rest, total, xs, ys = (pairs.field(n).to_pylist() for n in ("hi", "rest", "total", "x", "y"))
    known: dict[tuple[str, str], int] = {}
    out, at = [], 0
    for n in todo.value_lengths().to_pylist():
        best = 0.0
        for i in sorted(range(at, at + (n or 0)), key=hi.__getitem__, reverse=True):
            if hi[i] <= best:
                break
            pair = xs[i], ys[i]
            common = known.get(pair)
            if common is None:
                common = known[pair] = lcs_length(*pair)
            best = max(best, 100 - 100 * (rest[i] - 2 * common) / total[i])
        at += n or 0
        out.append(best)
    return pa.array(out, pa.float64())


def with_score(
    df: DataFrame,
    sets_a: Column,
    sets_b: Column,
    min_score: float | None = None,
    name: str = "score",
) -> DataFrame:
    """Add the best score over all pairs of ``sets_a`` x ``sets_b``, per row.

    With ``min_score``, rows whose upper bound is below it leave before Python is
    reached, and the rest is cut at the exact score. The one-element explodes keep
    the plan and the exact score from being inlined, and evaluated again, in these
    filters; filters on the input's own columns are still pushed to the scan.
    """
    sets = df.select("*", sets_a.alias("_a"), sets_b.alias("_b"))
    plan = sets.select(*df.columns, F.explode_outer(_score_plan(min_score)).alias("_plan"))
    if min_score is not None:
        plan = plan.filter((F.col("_plan.lo") >= min_score) | (F.size("_plan.todo") > 0))
    exact = plan.select("*", F.explode_outer(F.array(_best_open(F.col("_plan.todo")))).alias("_exact"))
    scored = exact.withColumn(name, F.greatest(F.col("_plan.lo"), F.col("_exact")))
    if min_score is not None:
        scored = scored.filter(F.col(name) >= min_score)
    return scored.drop("_plan", "_exact").withColumn(name, F.round(name, 4))


def token_set_ratio(
    df: DataFrame, a: str, b: str, normalize: bool = True, name: str = "score"
) -> DataFrame:
    """Similarity of two string columns of a table of pairs."""
    return with_score(
        df,
        word_sets(F.array(F.col(a)), normalize),
        word_sets(F.array(F.col(b)), normalize),
        name=name,
    )
