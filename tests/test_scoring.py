"""The block scorer alone, without Spark: tiles of any size give the same result."""

import numpy as np
import pyarrow as pa
import pytest

from kinmatch import Clause, SearchSpec
from kinmatch.operators import scoring as sc

SPEC = SearchSpec(
    (Clause("x", "vector", "should", 1.0, 0.3), Clause("a", "exact", "should", 2.0), Clause("y", "vector", "should", 0.5, 0.4)), 4, True, 1
)


def table(n, seed, query):
    rnd = np.random.default_rng(seed)
    cols = {
        "query_id" if query else "item_id": pa.array(rnd.permutation(n).astype(np.int64)),
        "v0": pa.array([None if rnd.random() < 0.1 else v for v in rnd.normal(size=(n, 3)).tolist()], pa.list_(pa.float32())),
        "v1": pa.array(rnd.normal(size=(n, 2)).tolist(), pa.list_(pa.float32())),
        "t0": pa.array(rnd.choice(["p", "q", "r"], n).tolist()),
    }
    if query:
        present = np.array([v is not None for v in cols["v0"].to_pylist()])
        cols["act"] = pa.array((present * 1 + 6).astype(np.int64))
        cols["gens"] = pa.array((present * 1 + 4).astype(np.int64))
        cols["heavy"] = pa.array(np.full(n, 2, np.int64))
        cols["base"] = pa.array([[1.5]] * n, pa.list_(pa.float64()))
    return pa.table(cols)


@pytest.mark.parametrize("gen", [None, 0, 1, 2])
@pytest.mark.parametrize("own", [False, True])
def test_tiles_agree(monkeypatch, gen, own):
    q, items = table(37, 1, True), table(53, 2, False)
    scoring = sc.Scoring.of(SPEC, own)
    whole = sc.score_block(q, items, scoring, gen)
    for tile in (5, 16, 40):
        monkeypatch.setattr(sc, "_TILE", tile)
        part = sc.score_block(q, items, scoring, gen)
        key = [("query_id", "ascending"), ("n", "ascending"), ("score", "descending"), ("item_id", "ascending")]
        assert part.sort_by(key).to_pylist() == whole.sort_by(key).to_pylist()
    per_query = [r["query_id"] for r in whole.to_pylist() if r["item_id"] is not None]
    assert max(per_query.count(i) for i in set(per_query)) <= 4


def test_generators_split_the_pairs():
    """Every pair that a vector clause hits is counted under exactly one of them."""
    q, items = table(30, 3, True), table(40, 4, False)
    scoring = sc.Scoring((SPEC.clauses[0], SPEC.clauses[1], SPEC.clauses[2]), 1, None)
    seen = [{(r["query_id"], r["item_id"]) for r in sc.score_block(q, items, scoring, g).to_pylist() if r["item_id"] is not None} for g in (0, 2)]
    everything = sc.score_block(q, items, scoring, None).to_pylist()
    assert not seen[0] & seen[1]
    assert seen[0] | seen[1] == {(r["query_id"], r["item_id"]) for r in everything if r["item_id"] is not None and r["hits"] & 5}


def test_mixed_dimensions_fail():
    rows = pa.chunked_array([pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float32()))])
    with pytest.raises(ValueError, match="dimension"):
        sc._matrix(rows)


def test_best_of_many():
    """The early cut of rows with many pairs keeps the same pairs, with many equal scores."""
    rnd = np.random.default_rng(9)
    r = np.sort(rnd.integers(0, 6, 3000))
    c = np.arange(3000)
    score = rnd.integers(0, 5, 3000).astype(float)
    want = [i for k in range(6) for i in sorted(np.nonzero(r == k)[0], key=lambda i: (-score[i], c[i]))[:7]]
    assert sc._best(r, c, score, 7).tolist() == want


@pytest.mark.parametrize("length", [1.0, 1e3, 1e6])
def test_long_vectors_lose_no_pair(length):
    """Copies, and pairs just above the threshold, are found whatever the norms and however many pairs a block has."""
    from kinmatch.operators.scoring import _near, _pair_similarity

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x *= length / np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.standard_normal((300, 64))
    step *= 0.999 / np.linalg.norm(step, axis=1, keepdims=True)
    r, c, sim = _near(np.concatenate([x, x + step]), x, 0.5)
    found = dict(zip(zip(r.tolist(), c.tolist()), sim.tolist()))
    assert all(found[i, i] == 1.0 for i in range(300))
    assert all(0.5 <= found[300 + i, i] < 0.51 for i in range(300))
    pairs = np.array(list(found))
    few = _pair_similarity(np.concatenate([x, x + step]), x, pairs[:5, 0], pairs[:5, 1])
    assert few.tolist() == [found[tuple(p)] for p in pairs[:5].tolist()]
