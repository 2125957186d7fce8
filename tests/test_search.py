import json

import pytest
from brute import lcs, token_set
from conftest import docs, plan_of
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark import flatten, search, search_fields, search_score, token_set_ratio
from shelfmark.functions.similarity import lcs_length

CATALOG = [
    {"id": "eu-nuts", "name": "NUTS codes", "description": "regions of the EU, \"nuts\" level"},
    {"id": "git-data-science-job", "name": "Job listings", "description": "data science jobs", "tags": ["jobs", "science"]},
    {"id": "ufo", "name": "ufo-records", "description": None, "tags": "sightings", "repository": "owner/ufo-records"},
    {"id": "bare"},
    {},
    {"id": "straße", "name": "Données de l'été", "tags": [], "category": "geo", "extra": {"notes": ["hidden words"]}},
    {"id": "twin", "name": "data science", "description": "science of data"},
]

KEYS = ("name", "id", "repository", "tags", "description")


def expected(keywords, keys=KEYS, normalize=True):
    out = []
    for pos, doc in enumerate(CATALOG):
        texts = [v for k in keys if k in doc for _, v in __import__("brute").flatten(doc[k])]
        scores = [token_set(t, k, normalize) for t in texts for k in keywords]
        out.append((pos, round(max(scores, default=0.0), 4)))
    return out


@pytest.fixture(scope="module")
def catalog(spark):
    return docs(spark, *[json.dumps(d, ensure_ascii=False) for d in CATALOG])


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("keywords", [["data science"], ["nuts", "UFO records"], ["ete donnees"], ["zzz"], ["Job, LISTINGS", "été"]])
def test_scores(catalog, keywords, normalize):
    got = search_score(catalog, keywords, normalize=normalize).select("pos", "score").collect()
    want = expected(keywords, normalize=normalize)
    assert sorted((r.pos, r.score) for r in got) == [(p, pytest.approx(s, abs=1e-4)) for p, s in want]


@pytest.mark.parametrize("keywords", [["data science"], ["science job"], ["sightings records"]])
@pytest.mark.parametrize("floor", [0, 35, 50, 75, 100])
def test_ranking(catalog, keywords, floor):
    want = sorted((r for r in expected(keywords) if r[1] >= floor), key=lambda r: (-r[1], r[0]))
    got = [(r.pos, r.score) for r in search(catalog, keywords, min_score=floor).collect()]
    assert got == [(p, pytest.approx(s, abs=1e-4)) for p, s in want]
    top = [(r.pos, r.score) for r in search(catalog, keywords, min_score=floor, limit=2).collect()]
    assert top == got[:2]


def test_threshold_is_inclusive(spark):
    catalog = docs(spark, json.dumps({"id": "abcd"}))
    assert search(catalog, "abxy", min_score=50).first()["score"] == 50.0
    assert search(catalog, "abxy", min_score=50.1).count() == 0


def test_no_keyword_finds_nothing(catalog):
    assert search(catalog, None).count() == 0
    assert search(catalog, [None]).count() == 0
    assert {r.score for r in search_score(catalog, None).collect()} == {0.0}


def test_one_keyword_as_text(catalog):
    assert search(catalog, "ufo").first()["id"] == "ufo"


def test_other_keys_come_from_the_document(catalog):
    got = search_score(catalog, ["hidden"], keys=["extra", "category"]).filter("score > 0").collect()
    assert [(r.id, r.score) for r in got] == [("straße", 100.0)]
    rows = search_fields(catalog, keys=["extra", "category"]).collect()
    assert {(r.id, r.key, r.value) for r in rows} == {
        ("straße", "extra__notes__0", "hidden words"),
        ("straße", "category", "geo"),
    }


def test_known_ratios(spark):
    pairs = [
        ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0),
        ("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat", 92.3077),
        ("a", None, 0.0),
        ("", "a", 0.0),
        ("a b", "b a", 100.0),
        ("#", "#", 0.0),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in token_set_ratio(df, "a", "b").collect():
        assert r.score == pytest.approx(r.want, abs=1e-4)


TEXT = st.text(alphabet="aAbc dé_-#1ß\t中", max_size=24)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=40, max_size=120), st.booleans())
def test_ratio_properties(spark, pairs, normalize):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    there = token_set_ratio(df, "a", "b", normalize).collect()
    back = {(r.a, r.b): r.score for r in token_set_ratio(df, "b", "a", normalize).collect()}
    for r in there:
        assert 0 <= r.score <= 100
        assert r.score == pytest.approx(token_set(r.a, r.b, normalize), abs=1e-4)
        assert r.score == pytest.approx(back[r.a, r.b], abs=1e-4)


@given(st.text(alphabet="abcdé", max_size=80), st.text(alphabet="abcdé", max_size=80))
def test_lcs(a, b):
    assert lcs_length(a, b) == lcs(a, b)


def test_texts_are_scored_whole_and_once(spark):
    """The end of a long text counts; one Arrow step in the plan, no shuffle for the score."""
    long = "x " * 50_000 + "needle in the end"
    catalog = docs(spark, json.dumps({"id": "long", "description": long}))
    found = search_score(catalog, ["needle end"], min_score=50)
    assert found.first()["score"] == 100.0
    plan = plan_of(search_score(catalog, ["needle end"], min_score=50))
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan
    assert plan_of(search(catalog, "needle", limit=3)).count("TakeOrderedAndProject") == 1


NESTED = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text(alphabet="ab é\"", max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(alphabet="xyz", min_size=1, max_size=2), inner, max_size=3),
    max_leaves=12,
)


def _text(value):
    if isinstance(value, bool):
        return str(value).lower()
    return None if value is None else str(value)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.text(alphabet="kl", min_size=1, max_size=2), NESTED, max_size=3), min_size=10, max_size=30), st.sampled_from(["__", ".", "-->"]))
def test_flatten(spark, records, sep):
    import brute

    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, doc string")
    want = sorted((i, k, str(_text(v))) for i, r in enumerate(records) for k, v in brute.flatten(r, sep))
    for depth in (1, 8):
        got = sorted((r.id, r.key, str(r.value)) for r in flatten(rows, "doc", sep=sep, max_depth=depth).collect())
        assert got == want


def test_flatten_has_no_depth_limit(spark):
    doc, key = "1", []
    for i in range(60):
        doc, key = ('{"k":%s}' % doc, ["k", *key]) if i % 2 else ("[%s]" % doc, ["0", *key])
    rows = spark.createDataFrame([(1, doc)], "id long, doc string")
    assert [tuple(r) for r in flatten(rows, "doc").collect()] == [(1, "__".join(key), "1")]
