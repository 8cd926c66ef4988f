import json

import pytest

from kinmatch import Clause, SearchSpec, item_schema
from kinmatch.plans.spec_table import spec_fields


def node(kind, column, weight=None, least=None, long=False, name=None):
    query = {"knn": {column: {"vector": column, "min_score": least}}} if kind == "knn" else {"term": {column: {"value": column} if long else column}}
    body = {"query": query}
    if weight is not None:
        body["weight"] = weight
    if name:
        body["_name"] = name
    return {"function_score": body}


# fixed values: field, placement, least similarity and weight of the film-title example
FILM = [
    ("title", "must", 0.65, 1.4), ("longDescription", "must", 0.4, 1.2), ("eidr", "should", None, 5), ("imdb", "should", None, 5),
    ("genre", "should", None, 1.1), ("subgenre", "should", None, 1.1), ("category", "should", None, 1.1),
    ("subcategory", "should", None, 1.1), ("releaseDate", "should", None, 1.3), ("duration", "should", None, 3),
    ("directors", "should", 0.7, 3), ("actors", "should", 0.7, 3), ("producers", "should", 0.6, 1.5), ("writers", "should", 0.6, 1.5),
]


def film(long):
    groups = {"must": [], "should": []}
    for f, occur, least, weight in FILM:
        if least is None:
            groups[occur].append(node("term", f, weight, long=long, name=f"{f}_function" if long else None))
        else:
            least = least if long else str(least)
            groups[occur].append(node("knn", f + "Embedding", weight, least, name=f"{f}Embedding_function" if long else None))
    return {"size": 15, "explain": True, "query": {"bool": {"minimum_should_match": "0", **groups}}}


@pytest.mark.parametrize("long", [True, False])
def test_film_example(long):
    spec = SearchSpec.from_json(json.dumps(film(long)))
    assert spec == SearchSpec.from_json(film(long))
    assert [(c.field, c.occur, c.min_score if c.kind == "vector" else None, c.weight) for c in spec.clauses] == FILM
    assert (spec.size, spec.explain, spec.min_should) == (15, True, 0)
    assert spec.clauses[0].name == "titleEmbedding_function"
    if long:
        assert spec.to_dict(named=True) == film(True)
    again = SearchSpec.from_json(spec.to_json())
    assert again.fields() == spec.fields() and set(again.clauses) == set(spec.clauses)
    assert [c.kind for c in again.must] == ["vector", "vector"]


def test_defaults_from_roles():
    spec = SearchSpec.from_roles({"Long Title": "VECTOR", "Notes": "IGNORE", "IMDB ID": "EXACT"})
    assert spec.clauses == (Clause("longTitle", "vector", "should", 1.0, 0.5), Clause("imdbId", "exact", "should", 1.0))
    assert (spec.size, spec.explain, spec.min_should) == (15, True, 0)
    with pytest.raises(ValueError):
        SearchSpec.from_roles({"a": "OTHER"})


def test_lenient_reading():
    spec = SearchSpec.from_json({"size": 0, "query": {"bool": {"minimum_should_match": "2 of them", "should": [{"match": {}}, node("knn", "aEmbedding")]}}})
    assert (spec.size, spec.explain, spec.min_should) == (10, False, 2)
    assert spec.clauses == (Clause("a", "vector", "should", 1.0, 0.0),)
    assert SearchSpec.from_json("{}").clauses == ()
    with pytest.raises(ValueError, match="JSON"):
        SearchSpec.from_json("{oops")
    with pytest.raises(ValueError):
        Clause("a", "exact", "should", -1.0)


def test_editing():
    spec = SearchSpec.vectors_required({"b": (0.5, 2.0)}, {"a": 1.5}, 7, 1)
    assert [c.occur for c in spec.clauses] == ["must", "should"] and spec.explain is False
    changed = spec.with_fields([Clause("c", "vector", "should", 1.0, 0.0)], remove=["a"])
    assert [c.field for c in changed.clauses] == ["b", "c"] and changed.size == 7


def test_item_schema():
    names = [(f.name, f.dataType.simpleString()) for f in item_schema({"Long Title": "VECTOR", "Year": "EXACT", "x y": "IGNORE"}).fields]
    assert names[4:] == [("longTitle", "string"), ("longTitleEmbedding", "array<float>"), ("year", "string"), ("xY", "string")]


def test_spec_table(spark):
    doubled = film(True)
    doubled["query"]["bool"]["should"].append(node("knn", "titleEmbedding", 9.0, 0.1))
    catalog = spark.createDataFrame([("i1", json.dumps(film(False))), ("i2", json.dumps(doubled)), ("i3", "{bad")], "index_name string, search_config string")
    rows = spec_fields(catalog).collect()
    one = {r.field: (r.placement, r.min_score, r.weight) for r in rows if r.index_name == "i1"}
    assert one == {f: (o, least, float(w)) for f, o, least, w in FILM}
    two = {r.field: (r.placement, r.min_score, r.weight) for r in rows if r.index_name == "i2"}
    assert two["title"] == ("should", 0.1, 9.0) and len(two) == 14
    assert not [r for r in rows if r.index_name == "i3"]
    assert {(r.size, r.explain, r.min_should) for r in rows} == {(15, True, 0)}


def test_stored_names_are_kept_and_bool_is_needed():
    clause = {"function_score": {"query": {"term": {"genre": "genre"}}, "weight": 2, "_name": "mine"}}
    spec = SearchSpec.from_json({"query": {"bool": {"should": [clause]}}})
    assert spec.clauses[0].name == "mine" and spec.clauses[0].weight == 2
    assert spec.to_dict(named=True)["query"]["bool"]["should"][0]["function_score"]["_name"] == "mine"
    for bad in ("{}", "[]", '{"query": {}}', '{"query": {"bool": null}}', "{"):
        with pytest.raises(ValueError):
            SearchSpec.from_json(bad, strict=True)


@pytest.mark.parametrize("typed,want", [("0", 1.0), ("", 1.0), ("x", 1.0), ("2.5kg", 2.5), (" 3", 3.0), (None, 1.0), (0, 1.0), ("-2e1", None), (".5", 0.5), ("0.0", 1.0)])
def test_typed_weights(typed, want):
    rows = {"a": {"kind": "vector", "weight": typed}, "b": {"kind": "none"}}
    start = SearchSpec((Clause("a", "exact", "should", 4.0), Clause("b", "exact")))
    if want is None:
        with pytest.raises(ValueError):
            start.edited(rows)
        return
    (made,) = start.edited(rows).clauses
    assert (made.kind, made.occur, made.weight, made.min_score) == ("vector", "should", want, 0.0)
