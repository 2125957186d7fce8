"""Files cut into records by many tasks, where a record has no line of its own.

Whether a byte is inside quotes, a comment or a nested value depends on all bytes before
it. So every block of a file is read twice: first each block tells where it leads from
each state it may be entered in; these steps are composed in file order, which gives every
block the state it is really entered in; then each block cuts out the records that begin
in it, reading on for the last one. No task holds more than a block and a record.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .files import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4 << 20
#: Bytes that a task reads of a large input, block after block.
SHARE = 16 << 20
_BOM = b"\xef\xbb\xbf"
_BLANK = b" \t\r\n"


class _Open:
    """Ranges of bytes of one file at a time."""

    def __init__(self):
        self.uri, self.file, self.size = None, None, 0

    def read(self, uri: str, start: int, length: int) -> bytes:
        if uri != self.uri:
            system, path = file_system(uri)
            self.uri, self.file = uri, system.open_input_file(path)
            self.size = self.file.size()
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def read_json(self, uri: str, start: int, length: int) -> bytes:
        """A range with blanks for a byte order mark."""
        data = self.read(uri, start, length)
        if start < 3 and self.read(uri, 0, 3) == _BOM:
            lead = min(3 - start, len(data))
            data = b" " * lead + data[lead:]
        return data


def _dealt(blocks: DataFrame, block: int) -> DataFrame:
    """Blocks dealt to tasks: a few for each core, or more with ``SHARE`` bytes each."""
    n = blocks.count()
    few = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(max(1, min(n, max(few, n * block // SHARE))), "uri", "block")


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(uri, size, block, start) of all blocks of a file or of the files of a folder, dealt to tasks."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), F.col("length").alias("size"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - F.lit(1), F.lit(0)) / F.lit(block)))
    blocks = stage(
        files.select("uri", "size", F.explode(numbers).alias("block")).select("*", (F.col("block") * F.lit(block)).alias("start")), "blocks"
    )
    return _dealt(blocks, block)


# ---- JSON arrays ------------------------------------------------------------------

#: States at a byte of JSON: outside texts, inside one, inside one after a backslash.
OUT, IN, ESCAPED = 0, 1, 2


def _structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, steps of depth) of the brackets and commas outside texts, and the state at the end; a comma is no step."""
    if state == ESCAPED and len(data):
        data = data.copy()
        data[0] = 32  # whatever it is, it is a part of the text
    quote = data == 34
    back = data == 92
    at_end = False
    if back.any():
        place = np.arange(len(data), dtype=np.int32)
        run = place - np.maximum.accumulate(np.where(back, np.int32(-1), place))  # backslashes up to here
        odd = run % 2 == 1
        quote[1:] &= ~odd[:-1]
        at_end = bool(odd[-1])
    inside = (np.cumsum(quote, dtype=np.int32) + (state != OUT)) % 2 == 1
    kind = np.zeros(256, np.int8)
    kind[[91, 123]], kind[[93, 125]], kind[44] = 1, -1, 2
    kinds = kind[data]
    places = np.flatnonzero((kinds != 0) & ~inside)
    steps = kinds[places]
    end = IN if (inside[-1] if len(inside) else state != OUT) else OUT
    if end == IN and (at_end or (not len(data) and state == ESCAPED)):
        end = ESCAPED
    return places, np.where(steps == 2, 0, steps).astype(np.int64), end


def json_step(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, change of depth) of a block entered in ``state``."""
    _, steps, end = _structure(np.frombuffer(data, np.uint8), state)
    return end, int(steps.sum())


def json_cuts(data: bytes, state: int, depth: int) -> tuple[list[tuple[int, bool]], int, int]:
    """Places of the array's brackets and commas, each with whether a record begins after it; state and depth at the end."""
    places, steps, end = _structure(np.frombuffer(data, np.uint8), state)
    after = depth + np.cumsum(steps)
    comma = (steps == 0) & (after == 1)
    opening = (steps == 1) & (after == 1)
    closing = (steps == -1) & (after == 0)
    cut = comma | opening | closing
    return list(zip(places[cut].tolist(), (~closing[cut]).tolist())), end, int(after[-1]) if len(after) else depth


def _json_steps(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open()
        for batch in batches:
            out = []
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                data = file.read_json(uri, start, block)
                begins = data.lstrip(_BLANK)[:1].decode("latin-1") or None
                out.append((begins, *(x for s in (OUT, IN, ESCAPED) for x in json_step(data, s))))
            columns = list(zip(*out)) or [()] * 7
            arrays = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = ["begins", *(f"{n}{s}" for s in range(3) for n in ("to", "by"))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uri", "size", "block", "start")), *arrays], ["uri", "size", "block", "start", *names])

    return run


def _json_entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a file in order: the state and depth each is entered in, and the file's first character before it."""
    uri, state, depth, first = None, OUT, 0, None
    for batch in batches:
        rows = batch.to_pydict()
        states, depths, firsts = [], [], []
        for i in range(batch.num_rows):
            if rows["uri"][i] != uri:
                uri, state, depth, first = rows["uri"][i], OUT, 0, None
            states.append(state)
            depths.append(depth)
            firsts.append(first)
            first = first or rows["begins"][i]
            state, depth = rows[f"to{state}"][i], depth + rows[f"by{state}"][i]
        new = [pa.array(states, pa.int64()), pa.array(depths, pa.int64()), pa.array(firsts, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uri", "size", "block", "start")), *new], ["uri", "size", "block", "start", "state", "depth", "first"])


def _json_records(block: int):
    """Task function: (file, index, body, whole) of the records that begin in each block."""

    def records(file: _Open, uri: str, start: int, state: int, depth: int, first: str | None) -> Iterator[tuple[int, bytes, bool]]:
        data = file.read_json(uri, start, block)
        size, at, open_ = file.size, start, None
        begins = first or data.lstrip(_BLANK)[:1].decode("latin-1")
        if begins and begins != "[":  # no array: the whole file is one text, of the block that begins it
            if first is None:
                yield start, file.read_json(uri, 0, size), False
            return
        if not begins:
            return
        parts: list[bytes] = []
        own, closed_at = True, 0 if depth == 0 and first is not None else None
        while data:
            cuts, state, depth = json_cuts(data, state, depth)
            done = 0
            for place, opens in cuts:
                if open_ is not None:
                    parts.append(data[done:place])
                    yield open_, b"".join(parts), True
                    parts, open_ = [], None
                    if not own:
                        return
                elif closed_at is not None and data[done:place].strip(_BLANK):
                    yield start + done, data[done:place], False
                done = place + 1
                closed_at = None if opens else done
                if opens and own:
                    open_ = at + done
            if open_ is None:
                # what stands behind the array is no record of it
                if own and closed_at is not None and data[closed_at:].strip(_BLANK):
                    yield at + closed_at, data[closed_at:], False
                return
            parts.append(data[done:])
            own, at = False, at + len(data)
            data = file.read_json(uri, at, block)
        if open_ is not None:  # the array does not end
            yield open_, b"".join(parts), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open()
        for batch in batches:
            for uri, start, state, depth, first in zip(*(batch[c].to_pylist() for c in ("uri", "start", "state", "depth", "first"))):
                found, held = [], 0
                for row in records(file, uri, start, state, depth, first):
                    if row[1].strip(_BLANK) or not row[2]:
                        found.append(row)
                        held += len(row[1])
                    if held > block:
                        yield _as_batch(uri, found)
                        found, held = [], 0
                yield _as_batch(uri, found)

    return run


def _as_batch(uri: str, found: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
    at, body, whole = zip(*found) if found else ((), (), ())
    text = pa.array([b.decode("utf-8", "replace") for b in body], pa.string())
    arrays = [pa.array([uri] * len(at), pa.string()), pa.array(at, pa.int64()), text, pa.array(whole, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, ["file", "index", "body", "whole"])


def _in_file_order(steps: DataFrame, through: Callable, schema: str, block: int) -> DataFrame:
    """The composed steps: one small row for each block, in file order."""
    ordered = steps.repartition("uri").sortWithinPartitions("uri", "block")
    return _dealt(stage(ordered.mapInArrow(through, schema), "entered"), block)


def json_array_records(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, index, body, whole): the items of the JSON arrays of files, cut block by block by many tasks.

    ``index`` is the place of an item's first byte. ``whole`` is false for what is no item of a
    complete array: a file that does not begin with a bracket (one row), text behind
    an array, and the last item of an array that does not end. Blank files give nothing;
    arrays one after another in a file are read as one.
    """
    names = ", ".join(f"{n}{s} long" for s in range(3) for n in ("to", "by"))
    steps = stage(file_blocks(spark, path, block).mapInArrow(_json_steps(block), f"uri string, size long, block long, start long, begins string, {names}"), "steps")
    entered = _in_file_order(steps, _json_entered, "uri string, size long, block long, start long, state long, depth long, first string", block)
    return entered.mapInArrow(_json_records(block), "file string, index long, body string, whole boolean")


# ---- delimited records --------------------------------------------------------------

#: States at a byte of a delimited file.
RECORD, FIELD, PLAIN, QUOTED, QUOTE_SEEN, COMMENT = range(6)


class Delimited:
    """Records of fields between separators; a field that begins with a quote goes to its closing quote.

    Inside quotes a doubled quote is one, and separators, comments and line breaks are text.
    A comment goes from its character to the end of the line. All marks are ASCII.
    """

    def __init__(self, sep: str = ",", comment: str | None = None, quote: str = '"'):
        s, c, q = (re.escape(x).encode() for x in (sep, comment or "", quote))
        stop = rb"\n" + s + c
        self.sep, self.comment, self.quote = sep.encode(), (comment or "").encode(), quote.encode()
        self.content = re.compile(rb"(?:[^" + q + rb"]++|" + q + q + rb")*+")
        self.plain = re.compile(rb"[^" + stop + rb"]*+")
        field = rb"(?:" + q + rb"(?:[^" + q + rb"]++|" + q + q + rb")*+(?:" + q + rb"|\Z))?+[^" + stop + rb"]*+"
        self.record = re.compile(field + rb"(?:" + s + field + rb")*+")

    def data_end(self, buf: bytes, at: int) -> tuple[int, int]:
        """(end of the record's data, start of the next record) of a record that starts at ``at``; -1 if it goes on."""
        end = self.record.match(buf, at).end()
        if end == len(buf):
            return end, -1
        if buf[end : end + 1] == b"\n":
            return end, end + 1
        line = buf.find(b"\n", end)
        return end, line + 1 if line >= 0 else -1

    def entered(self, buf: bytes, at: int, state: int) -> tuple[int, int]:
        """(start of the next record, -1) from any state; (-1, state at the end) if there is none."""
        while True:
            if at == len(buf):
                return -1, state
            if state == COMMENT:
                line = buf.find(b"\n", at)
                return (line + 1, -1) if line >= 0 else (-1, COMMENT)
            if state == QUOTE_SEEN:
                state = QUOTED if buf[at : at + 1] == self.quote else PLAIN
                at += state == QUOTED
            elif state in (RECORD, FIELD):
                state = QUOTED if buf[at : at + 1] == self.quote else PLAIN
                at += state == QUOTED
            elif state == QUOTED:
                at = self.content.match(buf, at).end()
                if at < len(buf):
                    at, state = at + 1, QUOTE_SEEN
                    if at < len(buf):
                        state = PLAIN
            else:
                at = self.plain.match(buf, at).end()
                if at < len(buf):
                    mark = buf[at : at + 1]
                    at += 1
                    if mark == b"\n":
                        return at, -1
                    state = FIELD if mark == self.sep else COMMENT

    def exits(self, buf: bytes) -> list[int]:
        """The state at the end of a block for each state it may be entered in."""
        known: dict[int, int] = {}
        out = []
        for state in range(6):
            at, end = (0, -1) if state == RECORD else self.entered(buf, 0, state)
            passed = []
            while end < 0 and at not in known:
                passed.append(at)
                _, after = self.data_end(buf, at)
                if after < 0 or after == len(buf):
                    end = RECORD if after == len(buf) else self.entered(buf, at, RECORD)[1]
                else:
                    at = after
            end = known[at] if end < 0 else end
            known.update(dict.fromkeys(passed, end))
            out.append(end)
        return out

    def records(self, read: Callable[[int, int], bytes], start: int, stop: int, state: int) -> Iterator[tuple[int, bytes]]:
        """(place, data without its comment) of the records that begin from ``start`` on and before ``stop``."""
        buf, ended = read(start, stop - start), False
        at = 3 if start == 0 and buf.startswith(_BOM) else 0
        if state != RECORD:
            at, _ = self.entered(buf, 0, state)
            if at < 0:
                return
        base = start
        while base + at < stop and at < len(buf):
            end, after = self.data_end(buf, at)
            if after < 0 and not ended:
                # the last record of the block: read on, twice as much each time
                more = read(base + len(buf), max(1 << 16, len(buf) - at))
                ended = not more
                buf, base, at = buf[at:] + more, base + at, 0
                continue
            yield base + at, buf[at:end]
            if after < 0:
                return
            at = after


def _delimited_steps(kind: Delimited, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open()
        for batch in batches:
            places = zip(batch["uri"].to_pylist(), batch["start"].to_pylist())
            exits = [kind.exits(file.read(u, s, block).removeprefix(b"" if s else _BOM)) for u, s in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exits, pa.list_(pa.int64()))], [*batch.schema.names, "exits"])

    return run


def _delimited_entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, state = None, RECORD
    for batch in batches:
        states = []
        for u, exits in zip(batch["uri"].to_pylist(), batch["exits"].to_pylist()):
            if u != uri:
                uri, state = u, RECORD
            states.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uri", "size", "block", "start")), pa.array(states, pa.int64())], ["uri", "size", "block", "start", "state"])


def _delimited_records(kind: Delimited, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Open()
        for batch in batches:
            for uri, start, size, state in zip(*(batch[c].to_pylist() for c in ("uri", "start", "size", "state"))):
                found, held = [], 0
                read = lambda at, n, uri=uri: file.read(uri, at, n)
                for at, data in kind.records(read, start, min(start + block, size), state):
                    data = data.removesuffix(b"\r")
                    if data.strip(b" "):
                        found.append((at, data))
                        held += len(data)
                    if held > block:
                        yield _delimited_batch(uri, found)
                        found, held = [], 0
                yield _delimited_batch(uri, found)

    return run


def _delimited_batch(uri: str, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    at, data = zip(*found) if found else ((), ())
    arrays = [pa.array([uri] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["file", "start", "data"])


def delimited_records(spark: SparkSession, path: str, sep: str = ",", comment: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(records (file, start, data), the first record): quoted line breaks whole, comments and blank lines out.

    ``data`` are bytes in the charset of the file, in which all marks are ASCII bytes.
    """
    kind = Delimited(sep, comment)
    blocks = file_blocks(spark, path, block)
    steps = stage(blocks.mapInArrow(_delimited_steps(kind, block), "uri string, size long, block long, start long, exits array<long>"), "steps")
    entered = _in_file_order(steps, _delimited_entered, "uri string, size long, block long, start long, state long", block)
    cut = _delimited_records(kind, block)
    schema = "file string, start long, data binary"
    # the first block that has a record: mostly the very first
    for row in entered.orderBy("uri", "block").toLocalIterator():
        one = entered.where((F.col("uri") == row["uri"]) & (F.col("block") == row["block"])).mapInArrow(cut, schema)
        if not (first := one.orderBy("start").limit(1)).isEmpty():
            return entered.mapInArrow(cut, schema), first
    return entered.mapInArrow(cut, schema), entered.mapInArrow(cut, schema).limit(0)
