"""Versioned tables, the stored catalog, and schemas kept beside tables."""

import pytest

from kinmatch import Clause, SearchSpec, match
from kinmatch.sources.catalog import StoredCatalog, load_spec
from kinmatch.sources.tables import Tables
from kinmatch.sources.versions import Conflict, VersionedTable

ROLES = {"Title": "VECTOR", "Genre": "EXACT"}


def rows(spark, *values, schema="k string, n int"):
    return spark.createDataFrame(list(values), schema)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replace_by_key(spark, tmp_path):
    table = VersionedTable(str(tmp_path))
    assert table.read(spark) is None and table.latest(spark) is None
    assert table.replace(rows(spark, ("a", 1), ("b", 2), (None, 3)), ["k"]) == 1
    assert table.replace(rows(spark, ("b", 20), ("c", 30), (None, 40)), ["k"]) == 2
    assert content(table.read(spark)) == [("a", 1), ("b", 20), ("c", 30), (None, 40)]
    assert content(table.read(spark, 1).where("k is not null")) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="repeat a key"):
        table.replace(rows(spark, ("x", 1), ("x", 2)), ["k"])


def test_columns_are_added_not_merged_from_files(spark, tmp_path):
    table = VersionedTable(str(tmp_path))
    table.replace(rows(spark, ("a", 1)), ["k"])
    table.replace(rows(spark, ("b", "x"), schema="k string, extra string"), ["k"])
    assert table.read(spark).columns == ["k", "n", "extra"]
    assert content(table.read(spark)) == [("a", 1, None), ("b", None, "x")]
    with pytest.raises(ValueError, match="column n"):
        table.replace(rows(spark, ("c", "text"), schema="k string, n string"), ["k"])


def test_of_two_writers_one_starts_again(spark, tmp_path):
    table = VersionedTable(str(tmp_path))
    table.replace(rows(spark, ("a", 0)), ["k"])
    runs = []

    def slow(now):
        runs.append(now.count())
        if len(runs) == 1:  # another writer publishes the same version meanwhile; its token may be lower or higher
            other = VersionedTable(str(tmp_path))
            other.publish(now.union(rows(spark, ("other", 1))), 1)
        return now.union(rows(spark, ("mine", 2)))

    try:
        version = table.change(spark, slow)
    except Conflict:
        pytest.fail("a conflict must be tried again")
    keys = [k for k, _ in content(table.read(spark))]
    assert "mine" in keys and version == table.latest(spark)["version"]
    assert len(runs) == version - 1  # one run if this writer won version 2, two if it came after the other
    assert ("other" in keys) == (version == 3)


def test_stored_catalog(spark, tmp_path):
    stored = StoredCatalog(str(tmp_path))
    assert stored.read(spark).count() == 0
    first = stored.create(spark, ROLES, "u", "f.xlsx").first()
    assert (first.index_name, first.created) == ("item001-u", True)
    assert stored.create(spark, ROLES, "v", index_name="item001-u").first().created is False
    assert stored.create(spark, ROLES, "v").first().index_name == "item002-v"
    spec = SearchSpec((Clause("title", "vector", "must", 2.0, 0.6),), 5, False, 0)
    stored.save_spec(spark, "item001-u", spec)
    again = StoredCatalog(str(tmp_path)).read(spark)
    assert again.count() == 2 and load_spec(again, "item001-u") == spec
    assert load_spec(again, "item002-v") == SearchSpec.from_json(SearchSpec.from_roles(ROLES).to_json(named=True))
    assert load_spec(stored.read(spark, 2), "item001-u") != spec  # older versions stay readable
    with pytest.raises(LookupError):
        stored.save_spec(spark, "none", spec)


def test_tables_keep_their_schema(spark, tmp_path):
    tables = Tables(str(tmp_path))
    assert tables.read(spark, "items") is None
    tables.append(rows(spark, ("i", "p", "1"), schema="index_name string, source_path string, title string"), "items")
    tables.append(rows(spark, ("i", "p", [1.0]), schema="index_name string, source_path string, titleEmbedding array<float>"), "items")
    got = tables.read(spark, "items")
    assert set(got.columns) == {"index_name", "source_path", "title", "titleEmbedding"}
    assert sorted((r.title, r.titleEmbedding) for r in got.collect() if r.title) == [("1", None)] and got.count() == 2


def test_counts_are_kept_by_ingest(spark, tmp_path):
    """A file that is counted again, or grows, counts once; nothing of the items is read for statistics."""
    tables = Tables(str(tmp_path))
    schema = "index_name string, item_id string, source_path string, genre string, year string"

    def put(*values):
        tables.append(rows(spark, *values, schema=schema), "items")

    put(("i", "1", "f1", "a", "1"), ("i", "2", "f1", "a", ""), ("j", "3", "f1", "a", "9"))
    tables.append_counts(spark, ["genre", "year"], ["i", "j"], ["f1"])
    put(("i", "4", "f2", "b", "1"))
    tables.append_counts(spark, ["genre", "year"], ["i"], ["f2"])
    tables.append_counts(spark, ["genre", "year"], ["i"], ["f2"])
    put(("i", "5", "f1", "a", "2"))
    tables.append_counts(spark, ["genre", "year"], ["i"], ["f1"])
    kept = tables.term_counts(spark, "i")
    assert content(kept) == [("", "", 4), ("genre", "a", 3), ("genre", "b", 1), ("year", "1", 2), ("year", "2", 1)]
    assert content(tables.term_counts(spark, "j")) == [("", "", 1), ("genre", "a", 1), ("year", "9", 1)]
    items = tables.read(spark, "items").where("index_name = 'i'")
    spec = SearchSpec((Clause("genre", "exact"), Clause("year", "exact")), 3)
    for options in ({}, {"scan_queries": 0}, {"scan_queries": 0, "rare_rows": 10}):
        plain, stored = (match(items, items, spec, counts=c, **options) for c in (None, kept))
        assert content(plain.hits.select("query_id", "rank", "item_id", "score")) == content(stored.hits.select("query_id", "rank", "item_id", "score"))
    assert "/items" not in kept._jdf.queryExecution().executedPlan().toString()
