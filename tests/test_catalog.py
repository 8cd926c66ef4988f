import datetime as dt

import pytest

from kinmatch import Clause, SearchSpec
from kinmatch.sources import catalog as cat

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
ROLES = {"Title": "VECTOR", "Genre": "EXACT", "Notes": "IGNORE"}


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "index_name string")


@pytest.mark.parametrize(
    "known,want",
    [
        (["item001-a", "item007-b", "other"], "item008-u"),
        ([], "item001-u"),
        (["items-x", "item-3", "xitem009-a"], "item001-u"),
        (["item1000-a", "item999-b"], "item1001-u"),
        (["item7", "item12x"], "item008-u"),
    ],
)
def test_next_name(spark, known, want):
    assert cat.next_index_name(names(spark, *known), "u").first()[0] == want


def test_create_list_save(spark):
    with pytest.raises(ValueError):
        cat.create_index(cat.empty_catalog(spark), {"a": "IGNORE"}, "u")
    one = cat.create_index(cat.empty_catalog(spark), ROLES, "u", "f.xlsx", now=NOW)
    assert [tuple(r) for r in one.status.collect()] == [("item001-u", True, "Index item001-u created successfully")]
    two = cat.create_index(one.catalog, ROLES, "v", "g.xlsx", now=NOW + dt.timedelta(hours=1))
    again = cat.create_index(two.catalog, {"Other": "EXACT"}, "u", "h.xlsx", index_name="item001-u")
    assert again.rows.count() == 0 and again.catalog.count() == 2
    assert again.status.first().message == "Index item001-u already exists"
    assert [r[0] for r in cat.list_indexes(two.catalog, "v").collect()] == ["item002-v"]
    row = cat.index_config(two.catalog, "item001-u").first()
    assert (row.vector_fields, row.exact_fields, row.file_name, row.created_at) == (["Title"], ["Genre"], "f.xlsx", NOW)
    assert cat.load_spec(two.catalog, "item001-u") == SearchSpec.from_roles(ROLES)
    spec = SearchSpec((Clause("title", "vector", "must", 2.0, 0.6),), 5, False, 0)
    later = NOW + dt.timedelta(days=1)
    saved = cat.save_spec(two.catalog, "item001-u", spec, later)
    assert cat.load_spec(saved, "item001-u") == spec and cat.load_spec(saved, "item002-v") == SearchSpec.from_roles(ROLES)
    assert {r.index_name: r.updated_at for r in saved.collect()}["item001-u"] == later
    assert cat.load_roles(saved, "item001-u") == {"Title": "VECTOR", "Genre": "EXACT"} and cat.load_roles(saved, "none") == {}
    with pytest.raises(LookupError):
        cat.load_spec(saved, "none")
    mine = cat.create_index(saved, ROLES, "u", "k.xlsx", now=NOW - dt.timedelta(days=9)).catalog
    assert [r.index_name for r in cat.indexes_by_creation(mine, "u").collect()] == ["item003-u", "item001-u"]


def test_roundtrip_without_the_named_indexes(spark, tmp_path):
    """Customers of other segments: the refused name exists, unknown names change nothing, and versions stay in step with the SQL."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, f"Customer#{k}", ("FURNITURE", "MACHINERY")[k == 1], k % 5) for k in (1, 2, 7, 8)]
    customers = spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    found = entry.queries()["catalog_roundtrip"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()['catalog_roundtrip']})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
