"""SentencePiece encoding by batched Viterbi in numpy, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15 | 1
#: Texts encoded at a time, in bytes, and words and (as a power of two) pairs of pieces remembered by a task.
CHUNK = 1 << 19
CACHED = 250_000
PAIRS = 20
SEEN = 21
_NEVER = 1 << 40
#: Stands for a character that is no piece.
UNKNOWN = -2


@dataclass
class Vocabulary:
    """Pieces of a model; numbers are in order of id, keys and their ids in order of key."""

    kind: str
    pieces: list[str]
    score: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    #: Whether any key begins with these SEEN bits; most substrings are dismissed by it.
    seen: np.ndarray
    key: np.ndarray
    power: np.ndarray
    length: np.ndarray
    #: Place of a piece in the order of merges, -1 for single characters.
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    data: list[bytes]
    byte: list[int]
    unknown: int
    longest: int

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 for none."""
        out = np.full(key.shape, -1, np.int64)
        maybe = np.nonzero(self.seen[key >> np.uint64(64 - SEEN)])
        key = key[maybe]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == key, self.ids[at], -1)
        return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    return out


def _key(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & (1 << 64) - 1
    return h


def _merge(text: str, rank: dict[str, int]) -> list[str]:
    """Byte-pair encoding of one text, merge by merge: the best pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        ranks = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == _NEVER:
            break
        i = ranks.index(best)
        if len(parts) == 2:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@cache
def vocabulary(model_file: str, kind: str = "bpe") -> Vocabulary:
    """The pieces of a SentencePiece model of kind ``bpe`` or ``unigram``.

    For byte-pair models every piece is split into the two pieces of its last merge; one
    that merging never arrives at is not used.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)])
    byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    has_bytes = all(model.is_byte(i) for i in byte)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    use = {p: i for i, p in enumerate(pieces) if not special[i]}
    if any(SPACE in p.lstrip(SPACE) for p in use):
        raise ValueError("pieces that reach over the end of a word are not supported")
    rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if kind == "bpe":
        order = {s: r for r, s in enumerate(sorted(set(score.tolist()), reverse=True))}
        ranks = {p: order[score[i]] for p, i in use.items() if len(p) > 1}
        for p, i in list(use.items()):
            if len(p) > 1:
                halves = _merge(p, ranks)
                if len(halves) != 2 or halves[0] not in use or halves[1] not in use:
                    del use[p]
                else:
                    rank[i], left[i], right[i] = ranks[p], use[halves[0]], use[halves[1]]
    length = np.array([len(p) for p in pieces])
    key = np.array([_key(p) for p in pieces], np.uint64)
    ids = np.array(sorted(use.values(), key=lambda i: key[i]), np.int64)
    if len(set(key[ids].tolist())) != len(ids):
        raise ValueError("two pieces have one key")
    seen = np.zeros(1 << SEEN, bool)
    seen[key[ids] >> np.uint64(64 - SEEN)] = True
    data = [p.replace(SPACE, " ").encode() for p in pieces]
    for i in range(n):
        if special[i]:
            data[i] = bytes([byte.index(i)]) if model.is_byte(i) else b""
    data[model.unk_id()] = " ⁇ ".encode()
    longest = int(length[ids].max())
    return Vocabulary(
        kind, pieces, score, key[ids], ids, seen, key, _powers(longest * 2), length, rank, left, right, data,
        byte if has_bytes else [], model.unk_id(), longest,
    )


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether byte-pair encoding leaves the pieces ``a`` and ``b`` side by side.

    Both are taken apart from their last merge backwards, the later merge first. If at
    some time the parts that touch make a piece whose merge comes before the next merge
    of either of them, merging would have crossed the border. Of equal merges the left
    one comes first.
    """
    out = np.ones(len(a), bool)
    at = np.flatnonzero((a >= 0) & (b >= 0))
    a, b = a[at], b[at]
    next_a, next_b = np.full(len(at), _NEVER), np.full(len(at), _NEVER)
    while len(at):
        found = v.find(v.key[a] * v.power[v.length[b]] + v.key[b])
        crosses = np.where(found >= 0, v.rank[found], _NEVER)
        bad = (crosses < next_a) & (crosses <= next_b)
        out[at[bad]] = False
        ra, rb = v.rank[a], v.rank[b]
        go = ~bad & ((ra >= 0) | (rb >= 0))
        apart = ra > rb
        next_a, next_b = np.where(apart, ra, next_a)[go], np.where(apart, next_b, rb)[go]
        a, b, at = np.where(apart, v.right[a], a)[go], np.where(apart, b, v.left[b])[go], at[go]
    return out


class Pairs:
    """:func:`compatible` for one vocabulary, with pairs met before remembered: one pair for each of 2^PAIRS places."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known = np.full(1 << PAIRS, -1, np.int64)  # a pair, and in the last bit whether it fits

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = ((a + 2 << 31) + b + 2) * 2  # neither is below UNKNOWN
        at = (pair.view(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - PAIRS)).view(np.int64)
        found = self.known[at]
        new = np.flatnonzero(found & ~1 != pair)
        if len(new):
            found[new] = pair[new] + compatible(self.v, a[new], b[new])
            self.known[at[new]] = found[new]
        return found & 1 == 1


def viterbi(v: Vocabulary, words: list[str], fits: Pairs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of one length end to end, and how many each word has; all words advance together.

    For every end the substrings that end there are looked up by hash; the value of a
    path through one is that up to its start plus its own. In a unigram model that is the
    score. In a byte-pair model it is 0 if the piece may follow the last piece of the path
    (see :func:`compatible`, asked by ``fits``), and minus infinity if not; one path is left, that of merging.
    The maxima over all starts give the backpointers. Characters that are no piece become
    their bytes, or the unknown id.
    """
    m, n = len(words), len(words[0])
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).astype(np.uint64)
    power = v.power if n <= v.longest else _powers(n)
    prefix = np.zeros((n + 1, m), np.uint64)
    for e in range(n):
        prefix[e + 1] = prefix[e] * np.uint64(_BASE) + code[:, e] + np.uint64(1)
    value = np.full((n + 1, m), -np.inf)
    value[0] = 0.0
    piece, size = np.full((n + 1, m), -1, np.int64), np.zeros((n + 1, m), np.int64)
    rare = v.score[v.ids].min() - 10.0
    fits = fits or Pairs(v)
    for e in range(1, n + 1):
        longest = min(e, v.longest)
        s = np.arange(e - 1, e - longest - 1, -1)
        found = v.find(prefix[e] - prefix[s] * power[1 : longest + 1, None])
        found[0][found[0] < 0] = UNKNOWN
        row, at = np.nonzero((found != -1) & (value[s] > -np.inf))  # row 0 has substrings of one character
        ids, start = found[row, at], s[row]
        if v.kind == "bpe":
            ok = fits(piece[start, at], ids)
            row, at, ids = row[ok], at[ok], ids[ok]
            value[e, at], piece[e, at], size[e, at] = 0.0, ids, row + 1
            continue
        new = value[start, at] + np.where(ids >= 0, v.score[ids], rare)
        np.maximum.at(value[e], at, new)
        best = new == value[e, at]
        row, at, ids = row[best][::-1], at[best][::-1], ids[best][::-1]
        piece[e, at], size[e, at] = ids, row + 1  # of equals the shortest
    # all words go back together, one piece a step
    end, steps, every = np.full(m, n), [], np.arange(m)
    while True:
        go = every[end[every] > 0]
        if not len(go):
            break
        step = np.full(m, -1, np.int64)
        step[go] = piece[end[go], go]
        if (step == UNKNOWN).any():
            # characters that are no piece are told apart by their place
            odd = go[step[go] == UNKNOWN]
            step[odd] = UNKNOWN - end[odd]
        end[go] -= size[end[go], go]
        steps.append(step)
        every = go
    table = np.stack(steps[::-1], 1)
    used = table != -1
    ids, counts = table[used], used.sum(1)
    if (ids < 0).any():
        ids, counts = _spelled(v, words, ids, counts)
    return ids.astype(np.int32), counts


def _spelled(v: Vocabulary, words: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in which characters that are no piece are their bytes, or one unknown id for a run of them."""
    out: list[int] = []
    found = []
    at = 0
    for word, n in zip(words, counts.tolist()):
        first = len(out)
        for i in ids[at : at + n].tolist():
            if i >= 0:
                out.append(i)
            elif v.byte:
                out += [v.byte[b] for b in word[UNKNOWN - i - 1].encode()]
            elif len(out) == first or out[-1] != v.unknown:
                out.append(v.unknown)
        found.append(len(out) - first)
        at += n
    return np.array(out, np.int64), np.array(found)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges end to end, each ``size`` numbers from ``start`` on."""
    until = np.cumsum(size)
    return np.repeat(start - until + size, size) + np.arange(until[-1] if len(until) else 0)


class Encoder:
    """Encodes texts word by word; words met before are remembered. Of more than ``cached`` the most used half stays."""

    def __init__(self, v: Vocabulary, cached: int = CACHED) -> None:
        self.v, self.cached, self.fits = v, cached, Pairs(v)
        line = "" if v.find(np.array([_key("\n")], np.uint64))[0] >= 0 else "\n"
        # a word begins at its blanks; a line feed that is no piece stands alone
        self._words = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else "")).findall
        self.known: dict[str, int] = {}
        self.uses = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.cached // 2])
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(stay.tolist())}
        size = np.diff(self.start)[stay]
        self.flat = self.flat[_ranges(self.start[stay], size)]
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.uses = self.uses[stay] // 2

    def _learn(self, words: Iterable[str]) -> None:
        new = sorted(words, key=len)
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        at = 0
        while at < len(new):
            n = len(new[at])
            end = at
            while end < len(new) and len(new[end]) == n and end - at < max(1, 100_000 // n):
                end += 1
            ids, counts = viterbi(self.v, new[at:end], self.fits)
            found.append(ids)
            sizes.append(counts)
            at = end
        first = len(self.known)
        self.known.update((w, first + i) for i, w in enumerate(new))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, *found])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more at the end)."""
        split = [self._words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        flat = [w for words in split for w in words]
        if len(self.known) > self.cached:
            self._forget()
        new = {w for w in flat if w not in self.known}
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.uses += np.bincount(index, minlength=len(self.known))
        size = np.diff(self.start)[index]
        until = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[_ranges(self.start[index], size)]
        words = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        return ids, until[words]


def decode_ids(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids; the blank before the first word is not part of it."""
    data = b"".join(map(v.data.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes, one text at least."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and size + n > CHUNK:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(
    df: DataFrame,
    text_col: str = "text",
    ids_col: str = "ids",
    model_file: str | None = None,
    kind: str = "bpe",
    keep: Sequence[str] | None = None,
    check: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all if not given) and the token ids of a text column.

    The ids are those that the model's own library gives. The model file is read on the
    driver and its tables go to the tasks. Every row gives one row; null and empty texts
    have no ids; a column that has the name of a new one is replaced; an empty table gives
    no rows. Whole texts are encoded, word by word. With ``check`` the ids are decoded in
    the same task, and decoded_sha256 and round_trip (is the text the same again?) added.
    """
    v = vocabulary(model_file or default_model(), kind)
    new = [ids_col, *(["decoded_sha256", "round_trip"] if check else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            column = batch.column("text")
            for a, b in _chunks(column):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                ids, start = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids, pa.int32()))
                columns = [*(batch.column(i).slice(a, b - a) for i in range(len(kept))), lists]
                if check:
                    back = [decode_ids(v, ids[x:y].tolist()) for x, y in zip(start, start[1:])]
                    columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()))
                    columns.append(pa.array([t == u for t, u in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *new])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids_col, ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema.add("decoded_sha256", "string").add("round_trip", "boolean") if check else schema)


def decode(
    df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_file: str | None = None, kind: str = "bpe"
) -> DataFrame:
    """``df`` with the text of a column of token ids.

    Encoded texts come back as they were, but for U+2581, with which the pieces mark
    blanks: it comes back as a blank. Null and empty lists give an empty text; ids that
    are null or no ids of the model are an error.
    """
    v = vocabulary(model_file or default_model(), kind)
    kept = [c for c in df.columns if c != text_col]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            found = [decode_ids(v, lists[i].values.to_pylist() if lists[i].is_valid else ()) for i in range(len(lists))]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], [*kept, text_col])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    return rows.mapInArrow(run, schema.add(text_col, "string"))
