"""Work-queue rows get stored vectors, else embedded ones, else an error; missing columns raise."""

import pytest

from kinmatch import Clause, SearchSpec, match
from kinmatch.functions import embed
from kinmatch.operators.related import map_queue, queue_vectors
from kinmatch.sources import catalog as cat
from kinmatch.sources.tables import Tables

SPEC = SearchSpec((Clause("actors", "vector", "must", 1.0, 0.9), Clause("genre", "exact", "should", 2.0)), 5)
ITEMS = [
    ("i1", "a", "x", "Ann Lee, Bo Ek", "drama"),
    ("i1", "b", "x", "Cy Oh", "drama"),
    ("i1", "c", "x", "Ann Lee, Bo Ek", "comedy"),
    ("i2", "a", "x", "Zed Zoe", "drama"),
]
QUEUE = [
    ("i1", "a", "Ann Lee, Bo Ek", "drama"),  # as stored
    ("i1", "b", "Ann Lee, Bo Ek, Ann Lee", "drama"),  # edited since: another text than the item's
    ("i1", "c", "", "comedy"),  # blank: the required clause is off
    ("i1", "d", "Cy Oh,", "none"),  # never stored
    ("i1", "e", None, ""),
    ("i2", "f", "Cy Oh", "drama"),
]


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame(ITEMS, "index_name string, item_id string, source_path string, actors string, genre string")
    items = embed.hashed_embedder()(items, "actors", "actorsEmbedding")
    queue = spark.createDataFrame(QUEUE, "index_name string, item_id string, actors string, genre string")
    return queue.cache(), items.cache()


def test_sources(tables):
    queue, items = tables
    sent = []

    def fn(texts):
        sent.extend(texts)
        return [[1.0] * 64 for _ in texts]

    made = queue_vectors(queue, items, SPEC, embed.function_embedder(fn), index_name="i1")
    got = {r.query_id: r.source for r in made.sources.collect()}
    assert got == {"a": "stored", "b": "embedded", "c": "blank", "d": "embedded", "e": "blank"}
    rows = {r.item_id: r for r in made.rows.collect()}
    stored = {r.item_id: r.actorsEmbedding for r in items.where("index_name = 'i1'").collect()}
    assert rows["a"].actorsEmbedding == stored["a"] and rows["b"].actorsEmbedding == [1.0] * 64
    assert rows["b"].actors == "Ann Lee, Bo Ek" and rows["c"].actorsEmbedding is None
    assert made.errors.count() == 0


def test_errors_do_not_search(spark, tables):
    queue, items = tables
    catalog = cat.create_index(cat.empty_catalog(spark), {"Actors": "VECTOR"}, "u", index_name="i1").catalog
    mapped = map_queue(cat.save_spec(catalog, "i1", SPEC), queue, items, "i1", scan_queries=0)
    assert sorted((r.query_id, r.field) for r in mapped.vectors.errors.collect()) == [("b", "actors"), ("d", "actors")]
    hits = sorted((r.query_id, r["rank"], r.item_id) for r in mapped.result.hits.collect())
    assert hits == [("a", 1, "a"), ("a", 2, "c"), ("c", 1, "c"), ("e", 1, "a"), ("e", 2, "b"), ("e", 3, "c")]
    totals = {r.query_id: r.total_results for r in mapped.result.summary.collect()}
    assert totals == {"a": 2, "c": 1, "e": 3}


def test_missing_columns_raise(tables):
    queue, items = tables
    with pytest.raises(ValueError, match="actorsEmbedding"):
        match(queue, items, SPEC)
    with pytest.raises(ValueError, match="actors"):
        queue_vectors(queue.drop("actors"), items, SPEC)
    with pytest.raises(ValueError, match="actorsEmbedding"):
        queue_vectors(queue, items.drop("actorsEmbedding"), SPEC)
    nowhere = SearchSpec((Clause("genre", "exact"), Clause("nowhere", "exact")))
    with pytest.raises(ValueError, match="nowhere"):
        match(items, items, nowhere)
    assert match(items.drop("genre"), items, SearchSpec((Clause("genre", "exact"),)), match_all=False).hits.count() == 0


def test_bucketed_tables_meet_without_a_shuffle(spark, tables, tmp_path):
    queue, items = tables
    store = Tables(str(tmp_path))
    one = store.write_bucketed(queue.where("index_name = 'i1'"), "queue", 4)
    two = store.write_bucketed(items.where("index_name = 'i1'"), "items", 4)
    joined = one.join(two.hint("merge"), "item_id", "left")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = queue_vectors(one, two, SPEC).sources
        assert {r.query_id: r.source for r in got.collect()} == {"a": "stored", "b": "error", "c": "blank", "d": "error", "e": "blank"}
    finally:
        for name in ("queue_by_item_id", "items_by_item_id"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
