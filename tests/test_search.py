"""Every route of the search gives the brute-force result: blocks, cells, value groups, rare values, scans."""

import random

import pytest
from pyspark.sql import types as T

from brute import search
from kinmatch import Clause, SearchSpec, match
from kinmatch.operators.lsh import Lsh

V, E = "vector", "exact"
SCHEMA = T.StructType(
    [T.StructField("item_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("a", "b", "c", "code")]
    + [T.StructField(c + "Embedding", T.ArrayType(T.FloatType())) for c in ("x", "y")]
)


def rows(n, seed, start=0):
    """A third of all rows share value and neighbourhood; codes are mostly unique; some cells are blank."""
    rnd = random.Random(seed)
    out = {}
    for i in range(start, start + n):
        hot = rnd.random() < 0.34

        def vec():
            if rnd.random() < 0.1:
                return None
            centre = [1.0, 0.0, 0.0] if hot else rnd.choice([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0]])
            return [round((m + rnd.gauss(0, 0.4)) * 64) / 64 for m in centre]

        out[i] = {
            "a": "hot" if hot else rnd.choice(["p", "q", "", "r"]),
            "b": rnd.choice(["1", "2", "3", ""]),
            "c": rnd.choice(["u", "v"]) if rnd.random() < 0.8 else "",
            "code": f"k{rnd.randrange(n)}" if rnd.random() < 0.9 else "",
            "xEmbedding": vec(),
            "yEmbedding": vec(),
        }
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, data in (("items", ITEMS), ("queries", QUERIES)):
        path = str(tmp_path_factory.mktemp("t") / name)
        spark.createDataFrame([[i, *r.values()] for i, r in data.items()], SCHEMA).coalesce(1).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


ITEMS = rows(150, 1)
QUERIES = {**rows(40, 2, start=120), 500: dict.fromkeys(ITEMS[0], "") | {"xEmbedding": None, "yEmbedding": None}}

SPECS = {
    "must_vector": SearchSpec((Clause("x", V, "must", 1.4, 0.5), Clause("a", E, "should", 2.0), Clause("b", E)), 5),
    "two_must": SearchSpec((Clause("x", V, "must", 1.4, 0.4), Clause("y", V, "must", 1.2, 0.6), Clause("a", E, "must", 2.0), Clause("code", E, "should", 5.0)), 7),
    "must_term": SearchSpec((Clause("a", E, "must", 1.0), Clause("x", V, "should", 3.0, 0.6), Clause("b", E), Clause("code", E, "should", 4.0)), 6, min_should=1),
    "should_only": SearchSpec((Clause("x", V, "should", 1.0, 0.7), Clause("y", V, "should", 2.0, 0.6), Clause("a", E), Clause("b", E, "should", 1.5), Clause("code", E)), 9),
    "should_two": SearchSpec((Clause("x", V, "should", 1.0, 0.6), Clause("a", E), Clause("b", E), Clause("c", E, "should", 0.0)), 9, min_should=2),
    "exact_only": SearchSpec((Clause("a", E, "must"), Clause("c", E, "must"), Clause("b", E), Clause("code", E)), 4),
    "exact_should": SearchSpec((Clause("a", E), Clause("b", E, "should", 0.5), Clause("c", E), Clause("code", E, "should", 3.0)), 8, min_should=2),
    "too_many": SearchSpec((Clause("x", V, "should", 1.0, 0.6), Clause("a", E)), 8, min_should=3),
    "all_pairs": SearchSpec((Clause("x", V, "must", 1.0, 0.0), Clause("y", V, "should", 1.0, 1.0)), 3),
}
ROUTES = {
    "groups": dict(scan_queries=0, rare_rows=0, block_rows=16, cell_rows=10**9),
    "rare": dict(scan_queries=0, rare_rows=12, block_rows=8, cell_rows=10, broadcast_bytes=0),
    "direct": dict(scan_queries=0, rare_rows=10**6, block_rows=64, cell_rows=40, stage_rows=1),
    "scan": dict(scan_queries=100),
    "combinations": dict(scan_queries=0, rare_rows=0, block_rows=16, cell_rows=10**9, subsets=0),
    "rare_combinations": dict(scan_queries=0, rare_rows=12, block_rows=16, cell_rows=10**9, subsets=0),
    "lsh": dict(scan_queries=0, rare_rows=12, block_rows=16, lsh=Lsh(6, 2, 3.0, 0.4)),  # wide buckets: nothing is missed here
}


CASES = [(n, r) for n in SPECS for r in ROUTES if r not in ("direct", "lsh", "rare_combinations") or n in ("must_vector", "must_term", "should_only")]


@pytest.mark.parametrize("name,route", CASES)
def test_same_as_brute_force(tables, name, route):
    spec, self_out = SPECS[name], name in ("must_term", "exact_should", "should_only")
    scoring = "constant" if name in ("two_must", "exact_should") else "bm25"
    result = match(
        tables["queries"], tables["items"], spec, exclude_self=self_out, term_scoring=scoring, **ROUTES[route]
    ).persist()
    want_hits, want_summary = search(QUERIES, ITEMS, spec, scoring, self_out)
    got = {}
    for r in sorted(result.hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.item_id, r.score, list(r.matched_queries)))
        if r.matched_queries:
            assert abs(sum(e.score for e in r.explanation) - r.score) < 1e-5
    for qid, want in want_hits.items():
        have = got.get(qid, [])
        assert [(i, names) for i, _, names in have] == [(i, names) for i, _, names in want], qid
        assert [s for _, s, _ in have] == pytest.approx([s for _, s, _ in want], abs=2e-6)
    summary = {r.query_id: (r.total_results, r.max_score) for r in result.summary.collect()}
    assert {q: t for q, (t, _) in summary.items()} == {q: t for q, (t, _) in want_summary.items()}
    result.unpersist()
