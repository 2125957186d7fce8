"""The pipeline stage by stage, and every registered query of the subpackage."""

from collections import Counter

import pytest
from compare import compare, database

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from shelfmark.llm import mixing, oracles, queries
from shelfmark.llm.alike import alike, shingles

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    out, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in pipeline.STAGES:
        after = pipeline.stage(step(spark, docs, FOLDER), "test")
        out[name] = (docs, after)
        docs = after
    return out


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality classifier", "near-duplicates", "mixing", "pieces"]


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "pieces" or after.columns == before.columns


@pytest.mark.parametrize("name, label, good", [("toxicity", "toxic", 0), ("quality classifier", "quality", 1)])
def test_filters(spark, stages, name, label, good):
    before, after = stages[name]
    rows, left = before.collect(), {tuple(r) for r in after.collect()}
    assert left <= {tuple(r) for r in rows}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = {r[0] for r in left}
    kept = [(r.doc_id in ids, labels[r.doc_id] == good) for r in rows if r.doc_id in labels]
    assert sum(k == g for k, g in kept) / len(kept) > 0.97
    assert sum(not k for k, g in kept if g) <= 2


def test_near_duplicates(stages):
    """Five-word Jaccard of 0.8 against brute force; one document of each component stays, the smallest id."""
    before, after = stages["near-duplicates"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    sets = [shingles((r.text or "").encode()) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r.doc_id for r in after.collect()) == sorted(rows[i].doc_id for i in {top(i) for i in range(len(rows))})


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "y"), (0, "A B c d", "x"), (None, "a b c d", None)]
    rows += [(7, None, "x"), (8, "", "x"), (None, "lone text of its own", "z"), (7, "something else", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(map(str, pipeline.drop_near_duplicates(spark, df, SMALL).collect()))
    want = [(0, "A B c d", "x"), (7, None, "x"), (None, "lone text of its own", "z"), (7, "something else", "x")]
    assert out == sorted(map(str, spark.createDataFrame(want, df.schema).collect()))


def test_mixing(stages):
    before, after = stages["mixing"]
    words = lambda rows: Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    rows = before.collect()
    goal = {s.name: s.target for s in mixing.targets(list(words(rows).items()), (1, 2, 3))}
    taken = words(after.collect())
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 3
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_pieces(stages):
    from sentencepiece import SentencePieceProcessor

    from shelfmark.llm.pieces import default_model

    library = SentencePieceProcessor(model_file=default_model())
    before, after = stages["pieces"]
    want = sorted((r.doc_id, library.encode(r.text)) for r in before.collect())
    assert sorted((r.doc_id, r.ids) for r in after.collect()) == want


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 0")
    for _, step in pipeline.STAGES:
        docs = pipeline.stage(step(spark, docs, SMALL), "test")
        assert docs.count() == 0


def test_run(spark):
    assert pipeline.run(spark, SMALL).count() > 0
    assert {**queries.QUERIES, "pipeline": 0}.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, name):
    error, n, _, _ = compare(queries.QUERIES[name](spark, SMALL), database(SMALL), oracles.SQL[name])
    assert error is None and n > 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op9_fingerprints"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoopJoin"))
