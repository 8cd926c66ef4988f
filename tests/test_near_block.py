"""Items held by exact values give what looking at every near pair gives, and look at few of them."""

import numpy as np
import pyarrow as pa
import pytest

from kinmatch import Clause, SearchSpec
from kinmatch.operators import near_block
from kinmatch.operators.near_block import NearBlock, suits
from kinmatch.operators.scoring import ItemBlock, Scoring

EXACT = [Clause("a", "exact", "should", 1.1), Clause("b", "exact", "should", 0.2), Clause("c", "exact", "should", 2.0)]
SPECS = {
    "two_of_three": SearchSpec((Clause("v", "vector", "must", 1.4, 0.7), *EXACT), 5, True, 2),
    "required": SearchSpec((Clause("a", "exact", "must"), Clause("v", "vector", "must", 2.0, 0.8), *EXACT[1:]), 4),
    "optional": SearchSpec((EXACT[0], EXACT[1], Clause("v", "vector", "should", 1.4, 0.75), EXACT[2]), 6, True, 1),
    "weightless": SearchSpec((Clause("v", "vector", "must", 0.0, 0.75), *EXACT), 5),
    "vector_only": SearchSpec((Clause("v", "vector", "must", 1.0, 0.75),), 5),
}


def _sides(spec, vectors, n, m, values, rng):
    def side(k):
        texts = [np.where(rng.random(k) < 0.2, "", rng.integers(0, values + f, k).astype(str)) for f in range(3)]
        return pa.array(list(vectors[rng.integers(0, len(vectors), k)]), pa.list_(pa.float32())), texts[: sum(c.kind == "exact" for c in spec.clauses)]

    (x, items), (v, asked) = side(n), side(m)
    gen = next(i for i, c in enumerate(spec.clauses) if c.kind == "vector")
    act, slot = np.full(m, 1 << gen), 0
    for i, c in enumerate(spec.clauses):
        if c.kind == "exact":
            act, slot = act | (asked[slot] != "").astype(np.int64) << i, slot + 1
    must = spec.clauses[gen].occur == "must"
    heavy = np.zeros(m, np.int64) if must else act & ~(1 << gen) & rng.integers(0, 16, m)
    gens = np.full(m, 1 << gen) | (0 if must else act & rng.integers(0, 16, m))
    base = [[1.0 + len(t) / 2, 2.0, 0.3][:slot] for t in (asked[0] if slot else [""] * m)]
    table = pa.table({"item_id": rng.permutation(n), "v0": x, **{f"t{k}": t for k, t in enumerate(items)}})
    columns = {"query_id": np.arange(m), "v0": v, **{f"t{k}": t for k, t in enumerate(asked)}, "act": act, "gens": gens, "heavy": heavy}
    return table, pa.table({**columns, "base": pa.array(base, pa.list_(pa.float64()))}), gen


def _found(tables, totals=True):
    out = {}
    for r in pa.concat_tables(tables).to_pylist():
        rows = out.setdefault(r["query_id"], [[], 0])
        if r["n"] is None:
            rows[0].append((-r["score"], r["item_id"], r["hits"], tuple(round(b, 9) for b in r["bases"])))
        elif totals:
            rows[1] += r["n"]
    return {k: (sorted(rows), n) for k, (rows, n) in out.items() if rows or n}


@pytest.mark.parametrize("tile", [(1 << 20, 4096), (600, 40)])
@pytest.mark.parametrize("alike", [True, False])
@pytest.mark.parametrize("name", SPECS)
def test_equal_to_every_pair(monkeypatch, name, alike, tile):
    monkeypatch.setattr(near_block, "FEW", 0)
    monkeypatch.setattr(near_block, "TILE", tile[0])
    monkeypatch.setattr(near_block, "WIDTH", tile[1])
    monkeypatch.setattr(near_block, "ROWS", tile[0])  # queries in parts
    rng, spec = np.random.default_rng(len(name)), SPECS[name]
    vectors = rng.random((30 if alike else 900, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    items, queries, gen = _sides(spec, vectors, 500, 200, 4, rng)
    scoring = Scoring.of(spec, False)
    assert suits(scoring, gen)
    want = list(ItemBlock(items, scoring, gen).score(queries))
    assert _found(NearBlock(items, scoring, gen).score(queries)) == _found(want)
    assert _found(NearBlock(items, scoring, gen, counted=False).score(queries), False) == _found(want, False)


@pytest.mark.parametrize("counted", [False, True])
def test_few_pairs_are_measured(monkeypatch, counted):
    """All vectors differ and most pairs are near: best rows and totals come from a small part of them."""
    measured, plain = [], near_block._pair_similarity
    monkeypatch.setattr(near_block, "_pair_similarity", lambda q, x, r, c: (measured.append(len(r)), plain(q, x, r, c))[1])
    rng, spec = np.random.default_rng(2), SearchSpec((Clause("v", "vector", "must", 1.4, 0.6), *EXACT), 5)
    vectors = rng.random((6000, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    items, queries, gen = _sides(spec, vectors, 4000, 600, 4, rng)
    found = _found(NearBlock(items, Scoring.of(spec, False), gen, counted).score(queries))
    assert len(found) == 600
    assert sum(measured) < 600 * 4000 / 20
    some = queries.slice(0, 40)
    assert {k: v for k, v in _found(ItemBlock(items, Scoring.of(spec, False), gen).score(some), counted).items()} == {k: v for k, v in found.items() if k < 40}
