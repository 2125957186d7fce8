"""The last stage decodes what it has encoded."""

import hashlib

import corpus_pipeline as pipeline


def test_pieces_are_decoded(spark):
    rows = [(1, "Some words, and more.", "en", "a", 21), (2, "a\u2581b", "en", "a", 3), (3, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pipeline.encode_pieces(spark, df, "").collect()}
    assert {i: r.round_trip for i, r in out.items()} == {1: True, 2: False, 3: True}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {i: r.decoded_sha256 for i, r in out.items()} == {1: sha(rows[0][1]), 2: sha("a b"), 3: sha("")}
