import pytest
from conftest import TABLES
from test_search import CATALOG, catalog  # noqa: F401

from shelfmark import search, search_indexed, write_search_index
from shelfmark.operators.index import candidates
from shelfmark.plans.views import docs as documents
from shelfmark.plans.views import parts


def same(spark, table, path, keywords, floors):
    for floor in floors:
        want = [(r.pos, r.id, r.score) for r in search(table, keywords, floor).select("pos", "id", "score").collect()]
        assert [tuple(r) for r in search_indexed(spark, path, keywords, floor).collect()] == want


@pytest.fixture(scope="module")
def small(spark, catalog, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("index") / "small")
    write_search_index(catalog, path)
    return path


@pytest.mark.parametrize("keywords", [["data science"], ["nuts", "UFO records", None], ["ete donnees"], ["zzz"], ["Job, LISTINGS", "été"]])
def test_same_rows(spark, catalog, small, keywords):  # noqa: F811
    same(spark, catalog, small, keywords, (0.5, 50, 100))


def test_edges(spark, catalog, small):  # noqa: F811
    assert search_indexed(spark, small, None).count() == 0 and search_indexed(spark, small, ["", " ,", None]).count() == 0
    for wrong in (0, -1, 101):
        with pytest.raises(ValueError):
            search_indexed(spark, small, ["nuts"], wrong)
    with pytest.raises(Exception, match="(?i)exists"):
        write_search_index(catalog, small)


def test_empty_catalog(spark, catalog, tmp_path):  # noqa: F811
    write_search_index(catalog.limit(0), str(tmp_path / "none"))
    assert search_indexed(spark, str(tmp_path / "none"), ["nuts"]).count() == 0


def test_parts(spark, tmp_path):
    """All thresholds give the rows of the search; a shared text is stored and compared once."""
    path, table = str(tmp_path / "parts"), parts(spark, TABLES)
    write_search_index(table, path)
    same(spark, table, path, ["Hot, ring", "promo 13"], (40, 50, 75))
    stored = spark.read.parquet(f"{path}/texts")
    assert stored.count() == stored.select("text_id").distinct().count() < spark.read.parquet(f"{path}/uses").count()


def test_few_texts_are_read(spark, tmp_path):
    """Long texts are compared only if their common words are nearly the whole keyword."""
    path, table = str(tmp_path / "docs"), documents(spark, TABLES)
    write_search_index(table, path)
    same(spark, table, path, ["und der tion"], (50, 80))
    all_texts = spark.read.parquet(f"{path}/texts")
    words = [["und", "der", "tion"]]
    assert candidates(spark, path, words, 80).where("length(text) > 200").count() < 0.5 * all_texts.where("length(text) > 200").count()
    plan = candidates(spark, path, words, 80)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(token" in plan
