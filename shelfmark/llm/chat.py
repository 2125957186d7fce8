"""Chat formatting: conversations rebuilt from event logs, rendered with a loss mask, read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is TURN, the role, a line feed, the text, END.
TURN, END = "<|turn|>", "<|end|>\n"
LEARNED = "assistant"
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    """A text in which no marker can begin: backslashes are doubled, ``<|`` becomes ``<\\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


Message = tuple[int | None, str, list[str]]


def apply_event(messages: list[Message], kind: str | None, turn: int | None, role: str | None, text: str | None) -> None:
    """Apply one event to the messages of a conversation so far.

    ``message`` (also a null kind) adds one; ``delta`` adds text to the last message of
    the turn, or begins it; ``edit`` replaces that message's text, or begins it;
    ``regenerate`` takes back the turn and all later ones and begins it anew. Null roles
    and texts are empty; a null turn is later than all others.
    """
    text = text or ""
    if kind not in (None, *KINDS):
        raise ValueError(f"unknown kind of event: {kind}")
    if kind == "regenerate":
        late = float("inf")
        messages[:] = [m for m in messages if (late if m[0] is None else m[0]) < (late if turn is None else turn)]
    if kind in ("delta", "edit"):
        for at, _, parts in reversed(messages):
            if at == turn:
                if kind == "edit":
                    parts.clear()
                parts.append(text)
                return
    messages.append((turn, role or "", [text]))


def render(messages: list[Message]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code points (from, to) that are learned from."""
    out, spans, at = [], [], 0
    for _, role, parts in messages:
        head, text = f"{TURN}{_role(role)}\n", escape("".join(parts))
        at += len(head)
        if role == LEARNED:
            spans.append((at, at + len(text)))
        at += len(text) + len(END)
        out += [head, text, END]
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_chats(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq") -> DataFrame:
    """(conv, formatted, spans) of every conversation of an event log.

    ``events`` has the conversation, a sequence number, kind, turn, role and text. The
    events of a conversation are brought together, sorted by sequence (nulls last; ties
    by turn, kind, role and text, so that reruns agree) and folded one after the other
    with :func:`apply_event`; a task holds the messages of one conversation at a time,
    which are one value of the result. Messages are rendered in the order in which they
    began. Repeated events are applied again; the events of a null conversation are one
    conversation; no events give no rows; other columns are left.
    """
    columns = {"_conv": conv_col, "_seq": seq_col, "_kind": "kind", "_turn": "turn", "_role": "role", "_text": "text"}
    rows = events.select(*[F.col(c).alias(a) for a, c in columns.items()])
    rows = rows.withColumns({"_turn": F.col("_turn").cast("long")} | {c: F.col(c).cast("string") for c in ("_kind", "_role", "_text")})
    kind = rows.schema["_conv"].dataType.simpleString()
    order = ["_conv", F.col("_seq").asc_nulls_last(), F.col("_turn").asc_nulls_last(), "_kind", "_role", "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(done: list) -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rendered = [render(m) for _, m in done]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in done], type_),
                    pa.array([f for f, _ in rendered], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s in rendered], span),
                ],
                ["_conv", "formatted", "spans"],
            )

        messages: list[Message] | None = None
        current = type_ = None
        for batch in batches:
            type_ = batch.schema.field("_conv").type
            done = []
            names = ("_conv", "_kind", "_turn", "_role", "_text")
            for conv, *event in zip(*[batch.column(n).to_pylist() for n in names]):
                if messages is None or conv != current:
                    if messages is not None:
                        done.append((current, messages))
                    current, messages = conv, []
                apply_event(messages, *event)
            if done:
                yield give(done)
        if messages is not None:
            yield give([(current, messages)])

    return (
        rows.repartition("_conv")
        .sortWithinPartitions(*order)
        .mapInArrow(run, f"_conv {kind}, formatted string, spans array<struct<start:bigint,end:bigint>>")
        .withColumnRenamed("_conv", conv_col)
    )


def read_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What formatted conversations hold, read back from them.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the digest of
    role, line feed, text and line feed of every turn, and the code points and digest of
    all text under the loss mask, unescaped.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    rows = formatted.select(F.col(conv_col).alias("_conv"), "formatted", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns, learned, chars = read_turns(text), hashlib.sha256(), 0
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    chars += len(said)
                    learned.update(said.encode())
                for c, v in zip(columns, (len(turns), whole.hexdigest(), chars, learned.hexdigest(), len(text))):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), *arrays], names)

    schema = f"_conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)
