"""Combinations held as bitmaps give what comparing every pair gives, in any number of parts."""

import random

import pyarrow as pa
import pytest

from kinmatch import Clause, SearchSpec
from kinmatch.operators import bitmaps
from kinmatch.operators.scoring import Scoring

COLS = [f"t{k}" for k in range(6)]
SPECS = {
    "should": SearchSpec(tuple(Clause(f"f{k}", "exact", "should", 1 + k / 8) for k in range(6)), 5, False, 2),
    "must": SearchSpec(tuple(Clause(f"f{k}", "exact", "must" if k == 1 else "should", 0.5 * k) for k in range(6)), 4),
    "must_one": SearchSpec(tuple(Clause(f"f{k}", "exact", "must" if k in (0, 3) else "should") for k in range(6)), 7, False, 1),
}


@pytest.mark.parametrize("first", [1 << 15, 64, 8])
@pytest.mark.parametrize("name", SPECS)
def test_equal_to_all_pairs(monkeypatch, name, first):
    monkeypatch.setattr(bitmaps, "FIRST", first)
    monkeypatch.setattr(bitmaps, "PART", min(first * 2, 1 << 17))
    rnd, spec = random.Random(first), SPECS[name]
    value = lambda k: "" if rnd.random() < 0.3 else str(rnd.randrange(2 + 30 * (k == 4) + k))
    items = sorted({tuple(value(k) for k in range(6)) for _ in range(300)}, key=lambda _: rnd.random())
    n, least = [rnd.choice([1, 1, 2, 70]) for _ in items], rnd.sample(range(10_000), len(items))
    asked = [tuple(value(k) for k in range(6)) for _ in range(40)]
    base = [[rnd.random() * 3 for _ in COLS] for _ in asked]
    heavy = [sum(1 << k for k in range(6) if q[k] != "" and rnd.random() < 0.9) for q in asked]
    table = pa.table({**{c: [x[k] for x in items] for k, c in enumerate(COLS)}, "n": n, "least": least, "item_id": range(len(items))})
    queries = pa.table({**{c: [q[k] for q in asked] for k, c in enumerate(COLS)}, "heavy": heavy, "query_id": range(len(asked)), "base": base})
    scoring = Scoring.of(spec, False)
    found = bitmaps.HeldCombinations(table, scoring, COLS, spec.size).score(queries).to_pylist()
    for i, q in enumerate(asked):
        want, total = [], 0
        must = [k for k in range(6) if heavy[i] >> k & 1 and spec.clauses[k].occur == "must"]
        for x, many, low in zip(items, n, least):
            hit = [k for k in range(6) if heavy[i] >> k & 1 and q[k] == x[k]]
            optional = len([k for k in hit if k not in must and spec.clauses[k].occur == "should"])
            if set(must) <= set(hit) and optional >= (spec.min_should if must else max(spec.min_should, 1)):
                total += many
                want.append((-round(sum(base[i][k] * spec.clauses[k].weight for k in hit), 6), low, sum(1 << k for k in hit)))
        have = [(-r["score"], r["least"], r["hits"]) for r in found if r["query_id"] == i and r["n"] is None]
        want = sorted(want)[: spec.size]
        assert [w[1:] for w in have] == [w[1:] for w in want]
        assert [w[0] for w in have] == pytest.approx([w[0] for w in want], abs=2e-6)
        assert sum(r["n"] for r in found if r["query_id"] == i and r["n"] is not None) == total
