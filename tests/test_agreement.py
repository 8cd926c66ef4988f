"""Combinations met in cells of rows that agree give what comparing every pair gives, from few of the pairs."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from kinmatch import Clause, SearchSpec, match
from kinmatch.operators import agreement
from kinmatch.operators.scoring import Scoring
from tests.brute import search

COLS = [f"t{k}" for k in range(6)]
SPECS = {
    "should": SearchSpec(tuple(Clause(f"f{k}", "exact", "should", 1 + k / 8) for k in range(6)), 5, False, 2),
    "must": SearchSpec(tuple(Clause(f"f{k}", "exact", "must" if k == 1 else "should", 0.5 * k) for k in range(6)), 4),
    "must_one": SearchSpec(tuple(Clause(f"f{k}", "exact", "must" if k in (0, 3) else "should") for k in range(6)), 7, False, 1),
    "three": SearchSpec(tuple(Clause(f"f{k}", "exact", "should") for k in range(6)), 3, False, 3),
}


@pytest.mark.parametrize("split", ["all", "some", "none"])
@pytest.mark.parametrize("name", SPECS)
def test_equal_to_all_pairs(monkeypatch, name, split):
    if split != "none":
        monkeypatch.setattr(agreement, "WHOLE", 8 if split == "all" else 2000)
        monkeypatch.setattr(agreement, "CELL", -1 if split == "all" else 1)
        monkeypatch.setattr(agreement, "ROW", 0)
        monkeypatch.setattr(agreement, "CHUNK", 17)
        monkeypatch.setattr(agreement, "TILE", 256)
        monkeypatch.setattr(agreement, "WAITING", 5)
    rnd, spec = random.Random(name), SPECS[name]
    value = lambda k: "" if rnd.random() < 0.3 else str(rnd.randrange(2 + 300 * (k == 4) + k))
    items = sorted({tuple(value(k) for k in range(6)) for _ in range(400)}, key=lambda _: rnd.random())
    n, least = [rnd.choice([1, 1, 2, 70]) for _ in items], rnd.sample(range(10_000), len(items))
    asked = [tuple(value(k) for k in range(6)) for _ in range(60)]
    base = [[rnd.random() * 3 for _ in COLS] for _ in asked]
    heavy = [sum(1 << k for k in range(6) if q[k] != "" and rnd.random() < 0.9) for q in asked]
    table = pa.table({**{c: [x[k] for x in items] for k, c in enumerate(COLS)}, "n": n, "least": least, "item_id": range(len(items))})
    queries = pa.table({**{c: [q[k] for q in asked] for k, c in enumerate(COLS)}, "heavy": heavy, "query_id": range(len(asked)), "base": base})
    tables = [table.slice(a, 150) for a in range(0, len(table), 150)]
    found = agreement.HeldCells(tables, Scoring.of(spec, False), COLS, spec.size).score(queries).to_pylist()
    for i, q in enumerate(asked):
        want, total = [], 0
        must = [k for k in range(6) if heavy[i] >> k & 1 and spec.clauses[k].occur == "must"]
        for x, many, low in zip(items, n, least):
            hit = [k for k in range(6) if heavy[i] >> k & 1 and q[k] == x[k]]
            optional = len([k for k in hit if spec.clauses[k].occur == "should"])
            if set(must) <= set(hit) and optional >= (spec.min_should if must else max(spec.min_should, 1)):
                total += many
                want.append((-round(sum(base[i][k] * spec.clauses[k].weight for k in hit), 6), low, sum(1 << k for k in hit)))
        have = [(-r["score"], r["least"], r["hits"]) for r in found if r["query_id"] == i and r["n"] is None]
        want = sorted(want)[: spec.size]
        assert [w[1:] for w in have] == [w[1:] for w in want]
        assert [w[0] for w in have] == pytest.approx([w[0] for w in want], abs=2e-6)
        assert sum(r["n"] for r in found if r["query_id"] == i and r["n"] is not None) == total


def _rows(n):
    rng = np.random.default_rng(5)
    return [np.where(rng.random(n) < 0.5, "", rng.integers(0, 5 + k, n).astype(str)) for k in range(20)]


def test_few_pairs_are_compared(monkeypatch):
    """20 fields of few values, no two rows alike: most pairs are counted by cells."""
    n, compared = 20_000, []
    spec = SearchSpec(tuple(Clause(f"f{k}", "exact", "should", 1 + k / 8) for k in range(20)), 10, False, 2)
    cols, rows = [f"t{k}" for k in range(20)], _rows(n)
    table = pa.table({**dict(zip(cols, rows)), "n": np.ones(n, np.int64), "least": np.arange(n), "item_id": np.arange(n)})
    heavy = sum((r != "").astype(np.int64) << k for k, r in enumerate(rows))
    queries = pa.table({**dict(zip(cols, rows)), "heavy": heavy, "query_id": np.arange(n), "base": pa.array([[1.5] * 20] * n)})
    plain = agreement._Asked._compare
    monkeypatch.setattr(agreement._Asked, "_compare", lambda self, qs, xs, *rest: (compared.append(len(qs) * len(xs)), plain(self, qs, xs, *rest))[1])
    held = agreement.HeldCells([table], Scoring.of(spec, False), cols, 10)
    found = held.score(queries)
    assert sum(compared) < n * n / 3
    totals = found.filter(pc.is_valid(found.column("n"))).to_pylist()
    totals = {r["query_id"]: r["n"] for r in totals}
    for i in range(0, n, 4001):
        hits = sum((r[i] != "") & (r == r[i]) for r in rows)
        assert totals.get(i, 0) == int((hits >= 2).sum())


@pytest.mark.parametrize("scale", [1.0, -1.0])
def test_search_by_combinations(spark, scale):
    """Points that take away are compared one by one; both ways find what a model of the search finds."""
    rnd = random.Random(3)
    rows = {i: {f"f{k}": "" if rnd.random() < 0.4 else str(rnd.randrange(3 + k)) for k in range(5)} for i in range(90)}
    rows |= {i + 100: rows[i] for i in range(20)}
    spec = SearchSpec(tuple(Clause(f"f{k}", "exact", "should", 1.0 + k) for k in range(5)), 200, False, 2)
    df = spark.createDataFrame([{"item_id": i, **row} for i, row in rows.items()])
    result = match(df, df, spec, scan_queries=0, rare_rows=0, subsets=0, block_rows=1, term_scale=scale)
    hits, summary = search(rows, rows, spec)
    have = {}
    for r in sorted(result.hits.collect(), key=lambda r: r["rank"]):
        have.setdefault(r.query_id, []).append((r.item_id, r.score))
    assert {r.query_id: r.total_results for r in result.summary.collect()} == {i: t for i, (t, _) in summary.items()}
    for i in rows:
        want = sorted(((x, scale * s) for x, s, _ in hits[i]), key=lambda r: (-r[1], r[0]))
        assert [s for _, s in have.get(i, [])] == pytest.approx([s for _, s in want], abs=2e-6)
        assert sorted(x for x, _ in have.get(i, [])) == sorted(x for x, _ in want)
