import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch import Clause, MatchOptions, SearchSpec, match
from kinmatch.operators.grouping import extend_groups, group_items
from kinmatch.operators.lsh import Lsh
from kinmatch.operators.radial import lsh_radial_join, radial_join, similarity

SCHEMA = "item_id string, v array<float>"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Clusters, one with a third of all rows; some exact copies."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 8)) * 2
    rows = []
    for i in range(400):
        k = 0 if i % 3 == 0 else int(rnd.integers(1, 6))
        v = centres[k] + rnd.normal(size=8) * 0.35 if i % 10 else centres[k]
        rows.append((f"i{i:03d}", [float(x) for x in np.float32(v)]))
    path = str(tmp_path_factory.mktemp("v") / "v")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path), np.array([r[1] for r in rows])


@pytest.mark.parametrize("block_rows,cell_rows", [(1024, 10**9), (32, 10**9), (64, 20), (16, 100)])
def test_radial_join_is_exact(vectors, block_rows, cell_rows):
    df, x = vectors
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    want = {(f"i{a:03d}", f"i{b:03d}") for a, b in zip(*np.nonzero(np.round(1 / (1 + d2), 12) >= 0.5))}
    got = radial_join(df, df, "v", 0.5, options=MatchOptions(block_rows=block_rows, cell_rows=cell_rows)).collect()
    assert len(got) == len(want) and {(r.query_id, r.item_id) for r in got} == want


def test_copies_meet_at_full_score(vectors):
    df, x = vectors
    got = radial_join(df, df, "v", 1.0, options=MatchOptions(cell_rows=50, block_rows=64))
    groups = {}
    for row in x:
        groups[tuple(row)] = groups.get(tuple(row), 0) + 1
    assert got.count() == sum(n * n for n in groups.values())


def test_cells_skip_pairs(vectors, spark):
    from kinmatch.operators.blocks import add_cells

    df, _ = vectors
    q = df.select(F.col("item_id").alias("query_id"), F.col("v").alias("v0"))
    side = df.select("item_id", F.col("v").alias("v0"))
    visits, placed = add_cells(q, side, "v0", 0.7, 12)
    pairs = visits.groupBy("_cell").count().join(placed.groupBy("_cell").agg(F.count("*").alias("m")), "_cell")
    assert pairs.agg(F.sum(F.col("count") * F.col("m"))).first()[0] < 400 * 400 / 2
    assert placed.count() == 400


def test_lsh_pairs_are_right(vectors):
    df, _ = vectors
    exact = {(r.query_id, r.item_id) for r in radial_join(df, df, "v", 0.6).collect()}
    near = {(r.query_id, r.item_id) for r in lsh_radial_join(df, df, "v", 0.6, lsh=Lsh(10, 2, 2.0, 0.1)).collect()}
    assert near <= exact and len(near) > 0.8 * len(exact)


def test_lsh_pairs_come_once_and_are_those_that_meet(vectors):
    """The buckets that rows are dealt to agree with the rule that says where pairs meet."""
    df, rows = vectors
    lsh = Lsh(4, 3, 1.5, 0.2)
    x = np.array([r.v for r in df.orderBy("item_id").collect()], float)
    names = [r.item_id for r in df.orderBy("item_id").collect()]
    place = lsh.places(x, 0.6)
    want = set()
    for i in range(len(x)):
        meets = lsh.meeting(np.repeat(place[i : i + 1], len(x), axis=0), place).any(axis=1)
        near = 1 / (1 + ((x - x[i]) ** 2).sum(axis=1)) >= 0.6
        want |= {(names[i], names[j]) for j in np.flatnonzero(meets & near)}
    got = [(r.query_id, r.item_id) for r in lsh_radial_join(df, df, "v", 0.6, lsh=lsh).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similarity_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0]


def test_dimension_mismatch_fails(spark):
    a = spark.createDataFrame([("1", [1.0, 2.0])], SCHEMA)
    b = spark.createDataFrame([("2", [1.0, 2.0, 3.0])], SCHEMA)
    with pytest.raises(Exception, match="dimension"):
        radial_join(a, b, "v", 0.1).collect()


def test_index_filter_empty_spec_and_source(spark):
    rows = [("i1", "a", "x", "n"), ("i1", "b", "x", "m"), ("i2", "c", "x", "n")]
    df = spark.createDataFrame(rows, "index_name string, item_id string, f string, g string")
    spec = SearchSpec((Clause("f", "exact"), Clause("gone", "exact")), 5)
    for scan in (0, 16):
        r = match(df, df, spec, index_name="i1", exclude_self=True, scan_queries=scan)
        assert sorted((h.query_id, h.item_id) for h in r.hits.collect()) == [("a", "b"), ("b", "a")]
        shown = r.with_source(df.where("index_name = 'i1'"))
        assert set(shown.columns) >= {"f", "g"} and "index_name" not in shown.columns
        empty = match(df, df, SearchSpec((), 2), index_name="i1", scan_queries=scan)
        assert sorted((h.query_id, h.item_id, h.score) for h in empty.hits.collect()) == [(q, i, 1.0) for q in "ab" for i in "ab"]
        assert match(df, df, SearchSpec((), 2), match_all=False, scan_queries=scan).hits.count() == 0
    with pytest.raises(ValueError):
        match(df, df, spec, term_scoring="other")


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_groups(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)]  # a long chain
    edges += [(500, i) for i in range(400, 499)]  # a hub
    edges += [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(60)]
    edges += [(7000, 7000)]
    df = spark.createDataFrame(edges, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("item_id", T.LongType())]))
    got = {r.item_id: r.group_id for r in group_items(df).collect()}
    assert got == components(edges)
    items = spark.createDataFrame([(i,) for i in (1, 2, 9999)], "item_id bigint")
    more = {r.item_id: r.group_id for r in group_items(df.where("item_id < 100"), items=items).collect()}
    assert more[9999] == 9999 and more[1] == 0


def test_groups_extended_equal_groups_at_once(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(0, k) for k in range(60, 80)]
    for cut in (0, 30, len(edges)):
        one, two = (spark.createDataFrame(e, "query_id bigint, item_id bigint") for e in (edges[:cut], edges[cut:]))
        whole = spark.createDataFrame(edges, "query_id bigint, item_id bigint")
        items = spark.range(125).withColumnRenamed("id", "item_id")
        got = sorted(tuple(r) for r in extend_groups(group_items(one), two, items=items).collect())
        assert got == sorted(tuple(r) for r in group_items(whole, items=items).collect())


def test_top_rows_in_parts(spark, monkeypatch):
    from kinmatch.operators import topk

    df = spark.range(5000).selectExpr("id % 3 AS k", "id AS item_id", "(id * 7919) % 101 AS score")
    whole = topk.top_rows(df, ["k"], [F.desc("score"), "item_id"], 1200, "r", "item_id", 5000)
    monkeypatch.setattr(topk, "PART_ROWS", 500)
    parts = topk.top_rows(df, ["k"], [F.desc("score"), "item_id"], 1200, "r", "item_id", 5000)
    assert parts.columns == whole.columns and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    plan = parts._jdf.queryExecution().toString()
    assert plan.count("Window [") >= 2


def test_held_blocks_copy_rows_no_oftener_with_more_rows(spark):
    """Shuffled rows grow in proportion: without keys, with one hot key, and where a part would be too large to hold."""
    from kinmatch.operators.blocks import held_blocks

    def copies(n, keys, held):
        q = spark.range(n).selectExpr("id AS query_id", "if(id % 4 > 0, 'hot', concat('k', id % 50)) AS k")
        side = q.withColumnRenamed("query_id", "item_id")
        a, b, block, _ = held_blocks(q, side, keys, n, n, held, 16)
        largest = b.groupBy(*block).count().agg(F.max("count")).first()[0]
        return (a.count() + b.count()) / n, largest

    for keys in ([], ["k"]):
        few, many = copies(8000, keys, 10**6), copies(64000, keys, 10**6)
        assert many[0] <= 1.3 * few[0] <= 13
        assert copies(64000, keys, 2000)[1] < 2600


@pytest.mark.parametrize("held_rows", [10**6, 70])
def test_streamed_queries_meet_all_items(vectors, held_rows):
    """Every block, with queries in batches of any size, gives each near pair once and whole totals."""
    df, x = vectors
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    near = np.round(1 / (1 + d2), 12) >= 0.5
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = radial_join(df, df, "v", 0.5, options=MatchOptions(held_rows=held_rows)).collect()
        both = df.withColumnRenamed("v", "vEmbedding").withColumn("v", F.lit("x"))
        totals = match(both, both, SearchSpec((Clause("v", "vector", "must", 1.0, 0.5),), 3), scan_queries=0, held_rows=held_rows).summary.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == near.sum() and {(r.query_id, r.item_id) for r in got} == {(f"i{a:03d}", f"i{b:03d}") for a, b in zip(*np.nonzero(near))}
    assert {r.query_id: r.total_results for r in totals} == {f"i{k:03d}": n for k, n in enumerate(near.sum(1))}


def test_matches_are_cut_to_a_forest_before_they_move(spark, monkeypatch):
    from kinmatch.operators import grouping

    edges = [(a, b) for a in range(60) for b in range(60)] + [(f, f) for f in (900, 901)]
    df = spark.createDataFrame(edges, "query_id bigint, item_id bigint").coalesce(1)
    rows = sorted(map(tuple, grouping.connected(df).collect()))
    assert len(rows) == 61 and rows[-2:] == [(900, 900), (901, 901)]
    names = df.selectExpr("concat('n', query_id) AS query_id", "concat('n', item_id) AS item_id")
    assert {r.group_id for r in group_items(names).collect()} == {"n0", "n900", "n901"}
