"""Benchmark decontamination: documents streamed through a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

WINDOW = 10
#: Words of the items in one automaton: about 100 MB in a worker. More items are more automata.
BLOCK = 200_000
#: Automata in one chain of steps, and on the driver at a time; longer chains are cut by a written table.
CHAIN = 4
#: Words of one piece of a long item; pieces overlap so that no window is lost.
PIECE = 20_000
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
# lower case for A to Z, a blank for all that separates words; bytes from 0x80 are parts of letters
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
SPANS = T.ArrayType(T.StructType().add("first", "long").add("last", "long"))


def words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of a to z, 0 to 9 and everything beyond ASCII, lower case for A to Z."""
    return data.translate(_TABLE).split()


class Automaton:
    """All substrings of a set of word lists.

    A state stands for the substrings that end at the same places; ``link`` leads to the
    state of the longest shorter suffix, ``length`` is that of a state's longest string.
    ``window[v]`` is the state of the last ``size`` words of what v stands for, and
    ``owners`` tells the lists that have that window. Lists of fewer words are a window
    each: ``short[v]`` has (length, owners) of those that end in v.
    """

    def __init__(self, lists: Sequence[tuple[str, list[bytes]]], size: int = WINDOW):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for owner, tokens in lists:
            if tokens:
                numbered.append((owner, [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens]))
        for _, ids in numbered:
            last = 0
            for t in ids:
                last = self._extend(last, t)
        self.least = min([size, *(len(ids) for _, ids in numbered)])
        self._mark(numbered)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _divided(self, p: int, q: int, t: int) -> int:
        """The state of the string of p and then t, taken out of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(t) == q:
            self.step[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        known = self.step[last].get(t)
        if known is not None:
            return self._divided(last, known, t)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and t not in self.step[p]:
            self.step[p][t] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._divided(p, self.step[p][t], t)
        return new

    def _mark(self, numbered: list[tuple[str, list[int]]]) -> None:
        size, states = self.size, len(self.length)
        by_length = sorted(range(states), key=self.length.__getitem__)
        self.window = [-1] * states
        for v in by_length:
            if self.length[v] >= size:
                self.window[v] = v if self.length[self.link[v]] < size else self.window[self.link[v]]
        owners: dict[int, set[str]] = {}
        ends: dict[int, dict[int, set[str]]] = {}
        for owner, ids in numbered:
            v = 0
            for i, t in enumerate(ids):
                v = self.step[v][t]
                if i + 1 >= size:
                    v = self.window[v]
                    owners.setdefault(v, set()).add(owner)
            if len(ids) < size:
                ends.setdefault(v, {}).setdefault(len(ids), set()).add(owner)
        self.owners = {v: tuple(o) for v, o in owners.items()}
        self.short: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * states
        for v in by_length[1:] if ends else ():
            own = tuple((n, tuple(o)) for n, o in ends.get(v, {}).items())
            self.short[v] = own + self.short[self.link[v]]

    def hits(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of words inside a window of a list, in order and apart; the lists with such windows).

        ``v`` and ``n`` are the state and the length of the longest match that ends at a word.
        """
        step, link, length, least, size = self.step, self.link, self.length, self.least, self.size
        spans: list[tuple[int, int]] = []
        seen: set[int] = set()
        owners: set[str] = set()
        v = n = 0
        for i, t in enumerate(map(self.vocabulary.get, tokens)):
            if t is None:
                v = n = 0
                continue
            to = step[v].get(t)
            while to is None:  # the first state has a step for every word
                v = link[v]
                n = length[v]
                to = step[v].get(t)
            v = to
            n += 1
            if n < least:
                continue
            back = 0
            if n >= size:
                back = size
                seen.add(self.window[v])
            for k, who in self.short[v]:
                if k <= n:
                    back = max(back, k)
                    owners.update(who)
            if back:
                join(spans, i + 1 - back, i + 1)
        for v in seen:
            owners.update(self.owners[v])
        return spans, owners


def join(spans: list[tuple[int, int]], first: int, last: int) -> None:
    """Add a span that ends after all others to spans in order and apart."""
    while spans and spans[-1][1] >= first:
        first = min(first, spans.pop()[0])
    spans.append((first, last))


_built: dict[str, Automaton] = {}


def _automaton(key: str, lists, size: int) -> Automaton:
    """The automaton of a block, built once in a worker."""
    if key not in _built:
        while len(_built) >= CHAIN:
            _built.pop(next(iter(_built)))
        _built[key] = Automaton([(o, w.split(b" ")) for o, w in lists], size)
    return _built[key]


def _pieces(size: int, longest: int):
    """Items as (item, words, n), long ones cut into pieces that overlap by ``size - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes, int]] = []
            for item, text in zip(batch.column("_item").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()):
                found = words(text or b"")
                for at in range(0, max(1, len(found) - size + 1), longest - size + 1):
                    if part := found[at : at + longest]:
                        out.append((item or "", b" ".join(part), len(part)))
            columns = list(zip(*out)) or [(), (), ()]
            types = [pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item", "words", "n"])

    return run


def _blocked(items: DataFrame, item_col: str, text_col: str, size: int, block: int) -> tuple[DataFrame, int]:
    """(distinct pieces of the items with the number of their ``block``, number of blocks); no block has over ``block`` words."""
    longest = max(2 * size, min(PIECE, block // 4))
    rows = items.select(F.col(f"`{item_col}`").cast("string").alias("_item"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    pieces = stage(rows.mapInArrow(_pieces(size, longest), "item string, words binary, n long").distinct(), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block)
    while True:
        number = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks)))
        dealt = pieces.withColumn("block", number)
        most = dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(block, longest):
            return dealt, blocks
        blocks = blocks + 1 + blocks // 8


def _through(key: str, lists, size: int, names: list[str]):
    """Task function: spans and items of one block added to those found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, lists.value, size)
        for batch in batches:
            total, spans, owners = [], [], []
            for text, old, had in zip(*(batch.column(c).to_pylist() for c in ("_text", "spans", "items"))):
                tokens = words((text or "").encode())
                new, who = automaton.hits(tokens)
                if old:
                    both, new = sorted([*new, *((s["first"], s["last"]) for s in old)], key=lambda s: s[1]), []
                    for first, last in both:
                        join(new, first, last)
                total.append(len(tokens))
                spans.append([{"first": a, "last": b} for a, b in new])
                owners.append(sorted(who.union(had or ())))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            found = [pa.array(total, pa.int64()), pa.array(spans, kind), pa.array(owners, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "n_words", "spans", "items"])

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block: int = BLOCK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, the columns ``keep``, n_words, spans, items) of every document.

    A window is ``size`` consecutive words of an item; an item of fewer words is one
    window, one of none has none. ``spans`` are the runs [first, last) of words of the
    document inside any occurrence of a window, ``items`` the ids of all items with an
    occurring window, as strings in order. Null texts have no words, a null item id is
    the empty string; rows of items with one id are one item, repeated documents stay,
    empty tables give no rows or no spans, other columns are left.

    Items are dealt to blocks of at most ``block`` words, each an automaton. A document
    passes all of them where it lies: nothing of it is shuffled or paired with items.
    """
    spark = docs.sparkSession
    kept = [id_col, *(c for c in keep if c != id_col)]
    if clash := {*kept} & {"n_words", "spans", "items"}:
        raise ValueError(f"columns {sorted(clash)} have the names of results")
    pieces, blocks = _blocked(items, item_col, item_text_col, size, block)
    columns = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)]
    plain = docs.select(
        *columns,
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.lit(None).cast(SPANS).alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    names = [f"_{i}" for i in range(len(kept))]
    carried = T.StructType([f for f in plain.schema if f.name not in ("spans", "items")])
    rest = [("n_words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType()))]
    found, open_ = plain, []
    for number in range(max(1, blocks)):
        lists = spark.sparkContext.broadcast(
            [(r["item"], bytes(r["words"])) for r in pieces.where(F.col("block") == number).drop("block").collect()]
        )  # at most ``block`` words
        open_.append(lists)
        last = number == max(1, blocks) - 1
        out = T.StructType([f for f in carried if not last or f.name != "_text"])
        for name, kind in rest:
            out = out.add(name, kind)
        found = found.mapInArrow(_through(uuid.uuid4().hex, lists, size, names if last else [*names, "_text"]), out)
        if not last:
            found = found.select(*names, "_text", "spans", "items")
            if len(open_) == CHAIN:
                found = stage(found, "leaks")
                for lists in open_:
                    lists.destroy()
                open_ = []
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])


def remove_leaks(found: DataFrame, text_col: str = "text", least: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Documents of ``find_leaks`` (with their text kept) without what leaked.

    A document goes if more than ``coverage`` of its words are in spans. In the others
    every span of at least ``least`` words is cut out of the text, from the start of its
    first to the end of its last word; the rest stays as it is. The column ``removed``
    counts the words cut. Documents without words stay.
    """
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            removed = [0] * len(texts)
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                cuts = [s for s in spans or () if s["last"] - s["first"] >= least]
                if not cuts or texts[i] is None:
                    continue
                ends = [m.span() for m in _WORD.finditer(texts[i].translate(_LOWER))]
                text, at = [], 0
                for s in cuts:
                    text.append(texts[i][at : ends[s["first"]][0]])
                    at = ends[s["last"] - 1][1]
                    removed[i] += s["last"] - s["first"]
                texts[i] = "".join([*text, texts[i][at:]])
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*names, "removed"])

    stay = F.coalesce(n_hit(F.col("spans")) <= F.lit(coverage) * F.col("n_words"), F.lit(True))
    return found.where(stay).mapInArrow(run, T.StructType([*found.schema]).add("removed", "long"))
