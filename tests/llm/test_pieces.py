"""SentencePiece encoding against the model's own library, and exact round trips."""

import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from shelfmark.llm import pieces
from shelfmark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.default_model())


def check(texts, library, cached=1000):
    v = pieces.vocabulary(pieces.default_model())
    ids, start = pieces.Encoder(v, cached).encode(texts)
    for i, t in enumerate(texts):
        own = ids[start[i] : start[i + 1]].tolist()
        assert own == library.encode(t), t[:80]
        assert pieces.decode_ids(v, own) == t.replace("▁", " ")


def test_blanks_signs_and_unknown_characters(library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("  ▁\nthe inga\t🙂日é,.!0") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [" " * k + "a" + " " * j for k in range(40) for j in (0, 1, 17, 33)] + ["\r\n x", "\x00a", "Ａ¼", "x" * 3000]
    check(texts, library)


def test_every_piece(library):
    v = pieces.vocabulary(pieces.default_model())
    check([v.pieces[i].replace("▁", " ") + v.pieces[j].replace("▁", " ") for i, j in zip(v.ids, v.ids[::-1])], library)


def test_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.round_trip == ("▁" not in text[r.doc_id])


def test_edges(spark, library):
    rows = [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "long " * 40_000)]
    df = spark.createDataFrame([(d, t, [7], "x", 0) for d, t in rows], "doc_id long, text string, ids array<int>, decoded string, `_0` int")
    out = pieces.decode(pieces.encode(df))
    assert sorted(out.columns) == sorted(df.columns)
    found = out.collect()
    assert sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in found) == sorted(
        (str(d), t or "", len(library.encode(t or ""))) for d, t in rows
    )
    assert pieces.encode(df.where("doc_id > 9")).count() == 0


def test_unigram_paths():
    """Scores instead of merges: the best of all ways to cut a word."""
    v = pieces.vocabulary(pieces.default_model())
    rng = np.random.default_rng(0)
    score = rng.normal(-5, 2, len(v.score))
    u = pieces.Vocabulary(**{**v.__dict__, "kind": "unigram", "score": score})
    place = {v.pieces[i]: i for i in v.ids.tolist()}
    for word in ("▁hello", "▁thing", "▁a", "▁zebra"):

        def best(w):
            if not w:
                return 0.0, []
            return max((best(w[:k])[0] + score[place[w[k:]]], [*best(w[:k])[1], place[w[k:]]]) for k in range(len(w)) if w[k:] in place)

        ids, counts = pieces.viterbi(u, [word, word])
        assert ids.tolist() == best(word)[1] * 2 and counts.tolist() == [len(best(word)[1])] * 2
