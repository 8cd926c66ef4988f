"""Scoring of query rows against one block of item rows.

Spark partitions and shuffles the blocks (`blocks.py`); here the items of a block are held, query rows that stream past are
scored with numpy, and only each query's best rows and its match count leave the block. Table layout on both sides:
id, v0.. (vectors, one per vector clause), t0.. (texts, one per exact clause); query rows also carry
base (score of a hit, per exact clause) and the clause bitmasks act, gens and heavy:

act    clauses that apply to this query (its value is not blank)
gens   clauses that produce pairs for this query; a pair is counted under the first of them that hits
heavy  exact clauses whose matches `value_groups.py` counts for this query
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinmatch.plans.spec import Clause, SearchSpec

DIGITS = 6  # scores are rounded before they are ranked
_SIM_DIGITS = 12  # similarities are rounded before the inclusive threshold test
_TILE = 1024  # rows per side that are scored at once


@dataclass(frozen=True)
class Scoring:
    clauses: tuple[Clause, ...]
    min_should: int
    keep: int | None  # best rows kept per query; None keeps all
    exclude_self: bool = False

    @classmethod
    def of(cls, spec: SearchSpec, exclude_self: bool) -> Scoring:
        return cls(spec.clauses, spec.min_should, spec.size, exclude_self)

    def slot(self, clause: int) -> int:
        """Position of a clause among the clauses of its kind: its column is v<slot> or t<slot>."""
        kind = self.clauses[clause].kind
        return sum(c.kind == kind for c in self.clauses[:clause])


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix of the column's precision, and which rows have one."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    valid = rows.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.unique(pc.drop_null(pc.list_value_length(rows))).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different dimension: {sorted(lengths)}")
    if not lengths:
        return np.zeros((len(rows), 0)), valid
    given = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths[0])
    if valid.all():
        return given, valid
    out = np.zeros((len(rows), lengths[0]), given.dtype)
    out[valid] = given
    return out, valid


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x, dtype=np.float64)


def _screen(q: np.ndarray, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that can have a squared distance of at most `limit`, by norms and inner products in one matrix product.

    `rounding` times (|q| + |x|) ** 2 bounds the error of the product, so it is taken off as part of it: no pair is lost. Single
    precision is used where that bound is small against the limit; it only lets more pairs through to the exact test."""
    q2, x2 = _squares(q), _squares(x)
    widest = np.sqrt(q2.max(initial=0.0)) + np.sqrt(x2.max(initial=0.0))
    kind, rounding = np.float64, 0.0
    for kind in (np.float32, np.float64):
        rounding = 2 * (q.shape[1] + 8) * float(np.finfo(kind).eps)
        if rounding * widest * widest <= limit / 32:
            break
    left, right = np.empty((len(q), q.shape[1] + 3), kind), np.empty((len(x), q.shape[1] + 3), kind)
    left[:, :-3], left[:, -3], left[:, -2], left[:, -1] = q, q2 * (1 - rounding), 1, np.sqrt(q2) * (-2 * rounding)
    left[:, :-3] *= -2
    right[:, :-3], right[:, -3], right[:, -2], right[:, -1] = x, 1, x2 * (1 - rounding), np.sqrt(x2)
    return np.divmod(np.flatnonzero(left @ right.T <= limit), max(len(x), 1))


def _similarity(d2: np.ndarray) -> np.ndarray:
    return np.round(1.0 / (1.0 + np.maximum(d2, 0.0)), _SIM_DIGITS)


def _same_dimension(q: np.ndarray, x: np.ndarray) -> None:
    if q.shape[1] != x.shape[1] and len(q) and len(x):
        raise ValueError(f"query vectors have dimension {q.shape[1]}, item vectors {x.shape[1]}")


def _pair_similarity(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Similarity of the row pairs (r, c), from the differences of their components: the one formula for what is reported."""
    if not r.size:
        return np.zeros(0)  # a side without any vector has no dimension
    _same_dimension(q, x)
    d2 = np.empty(r.size)
    for start in range(0, r.size, 32768):
        part = slice(start, start + 32768)
        diff = np.subtract(q[r[part]], x[c[part]], dtype=np.float64)
        d2[part] = np.einsum("ij,ij->i", diff, diff)
    return _similarity(d2)


def _near(q: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs with similarity >= `least`, and that similarity. `_screen` sorts out most pairs; the rest are tested by
    differences."""
    _same_dimension(q, x)
    loose = least - 1e-11
    if loose <= 0 or q.shape[1] != x.shape[1]:
        r, c = (a.reshape(-1) for a in np.indices((len(q), len(x))))
    else:
        r, c = _screen(q, x, 1.0 / loose - 1.0)
    sim = _pair_similarity(q, x, r, c)
    near = sim >= least
    return r[near], c[near], sim[near]


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Equal values as equal integers, and the values by number; null is -1."""
    coded = pc.dictionary_encode(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type))
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), coded.dictionary


def _codes_in(column: pa.ChunkedArray, known: tuple[np.ndarray, pa.Array]) -> np.ndarray:
    """The numbers that values of another column have in `known`; -2 for others."""
    codes = pc.fill_null(pc.index_in(column, value_set=known[1], skip_nulls=True), -2).to_numpy()
    return np.where(column.is_null().to_numpy(), -1, codes) if column.null_count else codes


def _best(r: np.ndarray, c: np.ndarray, score: np.ndarray, keep: int | None) -> np.ndarray:
    """Positions of the `keep` best pairs per row, best first; items are in id order, so c breaks ties.
    The pairs come in row order."""
    if keep is None or not r.size:
        return np.lexsort((c, -score, r))
    candidates = np.arange(r.size)
    if r.size > 8 * keep * len(np.unique(r)):
        # many pairs per row: drop those below the row's keep-th best score before sorting
        rows, row = np.unique(r, return_inverse=True)
        place = np.arange(r.size) - np.searchsorted(r, r, side="left")
        grid = np.full((rows.size, max(int(place.max()) + 1, keep)), -np.inf)
        grid[row, place] = score
        least = np.partition(grid, -keep, axis=1)[:, -keep]
        candidates = np.nonzero(score >= least[row])[0]
    order = candidates[np.lexsort((c[candidates], -score[candidates], r[candidates]))]
    first = np.searchsorted(r[order], r[order], side="left")
    return order[np.arange(order.size) - first < keep]


@dataclass
class _Tile:
    """A part of the block pair: its clause values on both sides."""

    act: np.ndarray
    gens: np.ndarray
    heavy: np.ndarray
    base: np.ndarray | None
    own: tuple[np.ndarray, np.ndarray] | None
    vectors: dict[int, tuple]  # clause -> (query matrix, has vector, item matrix, has vector)
    codes: dict[int, tuple]  # clause -> (query codes, item codes)
    once: Callable | None = None  # which near pairs are judged here, if they can meet elsewhere too

    def part(self, a: slice, b: slice) -> _Tile:
        return _Tile(
            self.act[a],
            self.gens[a],
            self.heavy[a],
            None if self.base is None else self.base[a],
            None if self.own is None else (self.own[0][a], self.own[1][b]),
            {i: (qv[a], qo[a], xv[b], xo[b]) for i, (qv, qo, xv, xo) in self.vectors.items()},
            {i: (left[a], right[b]) for i, (left, right) in self.codes.items()},
            self.once,
        )

    def pairs(self, gen: int | None, scoring: Scoring, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The pairs to look at: those that the generating clause hits, or all; and for a vector clause
        their similarity."""
        sim = None
        if gen is None:
            r, c = np.divmod(np.arange(len(self.act) * items), items)
        elif gen in self.vectors:
            qv, q_ok, xv, x_ok = self.vectors[gen]
            qi, xi = np.nonzero(q_ok & ((self.act >> gen) & 1 == 1))[0], np.nonzero(x_ok)[0]
            if qi.size == len(qv) and xi.size == len(xv):
                r, c, sim = _near(qv, xv, scoring.clauses[gen].min_score)
            else:
                r, c, sim = _near(qv[qi], xv[xi], scoring.clauses[gen].min_score)
                r, c = qi[r], xi[c]
            if self.once is not None and r.size:
                here = self.once(qv, xv, r, c)
                r, c, sim = r[here], c[here], sim[here]
        else:
            left, right = self.codes[gen]
            r, c = np.nonzero((left[:, None] == right[None, :]) & ((self.act >> gen) & 1 == 1)[:, None])
        if self.own is not None:
            other = self.own[0][r] != self.own[1][c]
            r, c, sim = r[other], c[other], None if sim is None else sim[other]
        return r, c, sim


def _score_tile(t: _Tile, scoring: Scoring, gen: int | None, items: int):
    """Kept pairs (r, c, score, hits, bases) of a tile and the number of counted pairs per query row."""
    clauses = scoring.clauses
    r, c, near = t.pairs(gen, scoring, items)
    n = r.size
    score, bases = np.zeros(n), np.zeros((n, len(clauses)))
    hits, required, must_on = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
    optional, group_required, group_optional = np.zeros(n, np.int32), np.ones(n, bool), np.zeros(n, np.int32)
    group_any, taken_before = np.zeros(n, bool), np.zeros(n, bool)
    for i, clause in enumerate(clauses):
        active = (t.act[r] >> i) & 1 == 1
        if i == gen and near is not None:
            hit = np.ones(n, bool)
            bases[:, i] = near
        elif i in t.vectors:
            qv, q_ok, xv, x_ok = t.vectors[i]
            use = np.nonzero(active & q_ok[r] & x_ok[c])[0]
            sim = np.full(n, -1.0)
            sim[use] = _pair_similarity(qv, xv, r[use], c[use])
            hit = (sim >= clause.min_score) & (sim >= 0)
            bases[:, i] = np.where(hit, sim, 0.0)
        else:
            left, right = t.codes[i]
            hit = active & (left[r] == right[c])
            bases[:, i] = np.where(hit, t.base[r, scoring.slot(i)], 0.0)
        score += bases[:, i] * clause.weight
        hits |= hit.astype(np.int64) << i
        in_group = hit & ((t.heavy[r] >> i) & 1 == 1)
        group_any |= in_group
        if clause.occur == "must":
            required &= hit | ~active
            group_required &= in_group | ~active
            must_on |= active
        else:
            optional += hit
            group_optional += in_group
        if gen is not None and i < gen:
            taken_before |= hit & ((t.gens[r] >> i) & 1 == 1)
    matched = required & (optional >= scoring.min_should) & (must_on | (hits != 0)) & ~taken_before
    counted = matched & ~(group_any & group_required & (group_optional >= scoring.min_should))
    score = np.round(score, DIGITS)
    pick = np.nonzero(matched)[0]
    pick = pick[_best(r[pick], c[pick], score[pick], scoring.keep)]
    counts = np.bincount(r[counted], minlength=len(t.act))
    return (r[pick], c[pick], score[pick], hits[pick], bases[pick]), counts


class ItemBlock:
    """The items of a block, held in id order while query rows stream past."""

    def __init__(self, items: pa.Table, scoring: Scoring, gen: int | None, once: Callable | None = None) -> None:
        self.items, self.scoring, self.gen, self.once = items.sort_by("item_id"), scoring, gen, once
        self.vectors, self.codes = {}, {}
        for i, clause in enumerate(scoring.clauses):
            if clause.kind == "vector":
                self.vectors[i] = _matrix(self.items.column(f"v{scoring.slot(i)}"))
            else:
                self.codes[i] = _coded(self.items.column(f"t{scoring.slot(i)}"))
        self.own = _coded(self.items.column("item_id")) if scoring.exclude_self else None

    def score(self, q: pa.Table) -> Iterator[pa.Table]:
        """Rows (query_id, item_id, score, hits, bases, n): the kept pairs (bases: unweighted score per clause),
        then per query one row with a null item and the number of pairs it adds to the query's total. With
        `gen` only pairs which that clause hits, and no earlier generator of the query, are taken; without it
        every pair is. Rows are scored in tiles, and of a tile row only the best pairs so far are kept, which bounds the
        memory of a task; pairs that are all wanted leave tile by tile."""
        scoring, vectors, codes = self.scoring, {}, {}
        for i, clause in enumerate(scoring.clauses):
            if clause.kind == "vector":
                vectors[i] = (*_matrix(q.column(f"v{scoring.slot(i)}")), *self.vectors[i])
            else:
                codes[i] = (_codes_in(q.column(f"t{scoring.slot(i)}"), self.codes[i]), self.codes[i][0])
        whole = _Tile(
            *(q.column(n).to_numpy() for n in ("act", "gens", "heavy")),
            np.stack(q.column("base").to_numpy()) if codes and q.num_rows else None,
            None if self.own is None else (_codes_in(q.column("query_id"), self.own), self.own[0]),
            vectors,
            codes,
            self.once,
        )
        for a in range(0, q.num_rows, _TILE):
            rows, found, waiting = q.slice(a, _TILE), [], 0
            counts = np.zeros(rows.num_rows, np.int64)
            for b in range(0, self.items.num_rows, _TILE):
                tile = whole.part(slice(a, a + _TILE), slice(b, b + _TILE))
                (r, c, *rest), n = _score_tile(tile, scoring, self.gen, min(_TILE, self.items.num_rows - b))
                counts += n
                found.append((r, c + b, *rest))
                if scoring.keep is None:
                    yield _result(rows, self.items, found.pop(), np.zeros_like(counts))
                    continue
                waiting += r.size
                if waiting > 8 * scoring.keep * _TILE:
                    found = [_merged(found, scoring.keep)]
                    waiting = found[0][0].size // 2
            none = np.zeros(0, np.int64)
            picked = _merged(found, scoring.keep) if found else (none, none, np.zeros(0), none, np.zeros((0, len(scoring.clauses))))
            yield _result(rows, self.items, picked, counts)


def _merged(found: list[tuple], keep: int | None) -> tuple:
    """The best pairs of several tiles of the same query rows."""
    if len(found) == 1:
        return found[0]
    picked = tuple(np.concatenate(parts) for parts in zip(*found))
    by_row = np.argsort(picked[0], kind="stable")
    picked = tuple(p[by_row] for p in picked)
    pick = _best(*picked[:3], keep)
    return tuple(p[pick] for p in picked)


def score_block(q: pa.Table, items: pa.Table, scoring: Scoring, gen: int | None, once: Callable | None = None) -> pa.Table:
    """All rows of `ItemBlock.score` at once."""
    found = list(ItemBlock(items, scoring, gen, once).score(q))
    if not found:
        none = np.zeros(0, np.int64)
        found = [_result(q, items, (none, none, np.zeros(0), none, np.zeros((0, len(scoring.clauses)))), none)]
    return pa.concat_tables(found)


def _result(q: pa.Table, items: pa.Table, picked: tuple, counts: np.ndarray) -> pa.Table:
    r, c, score, hits, bases = picked
    who = np.nonzero(counts)[0]
    ids, item_ids = q.column("query_id"), items.column("item_id")

    def tail(values: pa.Array) -> pa.ChunkedArray:
        return pa.chunked_array([values, pa.nulls(who.size, values.type)])

    offsets = np.arange(len(r) + 1, dtype=np.int32) * bases.shape[1]
    kept = item_ids.take(pa.array(c, pa.int64())).combine_chunks()
    kept = pa.concat_arrays(kept.chunks) if isinstance(kept, pa.ChunkedArray) else kept
    return pa.table(
        {
            "query_id": ids.take(pa.array(np.concatenate([r, who]), pa.int64())),
            "item_id": tail(kept),
            "score": tail(pa.array(score, pa.float64())),
            "hits": tail(pa.array(hits, pa.int64())),
            "bases": tail(pa.ListArray.from_arrays(pa.array(offsets), pa.array(bases.reshape(-1), pa.float64()))),
            "n": pa.chunked_array([pa.nulls(len(r), pa.int64()), pa.array(counts[who], pa.int64())]),
        }
    )


def result_schema(query_id: str, item_id: str) -> str:
    return f"query_id {query_id}, item_id {item_id}, score double, hits bigint, bases array<double>, n bigint"
