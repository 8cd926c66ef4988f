"""Rows near a vector within a block, without looking at every near pair.

What a pair scores for exact clauses depends only on which values agree, so items are held by their exact values. For queries of
the same exact values whole groups of items are left out that could not match whatever their vectors, and the others come in
order of what they score: once a query has its `keep` best rows, a pair has to be near enough to come before the last of them, and
the groups that cannot are passed over. The number of matches, where it is asked for, is counted from one matrix product; only
pairs within its rounding error of the least similarity are measured by differences. Rows that agree in vector and exact
values are held once, with their number and order of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kinmatch.operators.scoring import DIGITS, ItemBlock, Scoring, _codes_in, _matrix, _pair_similarity, _result, _same_dimension, _squares

#: Groups of items by exact values up to which a block is held by them, and pairs and items that are compared at once.
GROUPS, TILE, WIDTH = 4096, 1 << 20, 4096
#: Pairs below which all of them are looked at, in fewer steps.
FEW = 1 << 21
#: Best rows of all queries that are looked at together.
ROWS = 1 << 20
_SLACK = 2.0 * 10.0**-DIGITS


def suits(scoring: Scoring, gen: int | None) -> bool:
    """Whether pairs differ in exact values and one vector only, and are cut to the best."""
    if gen is None or scoring.exclude_self or scoring.keep is None:
        return False
    vectors = [i for i, c in enumerate(scoring.clauses) if c.kind == "vector"]
    return vectors == [gen] and scoring.clauses[gen].min_score > 1e-6


def _numbered(columns: list[np.ndarray], rows: int) -> np.ndarray:
    """Equal rows of the columns as equal numbers from 0 on."""
    out = np.zeros(rows, np.int64)
    for column in columns:
        values, at = np.unique(column, return_inverse=True)
        out = np.unique(out * len(values) + at, return_inverse=True)[1]
    return out


def _alike(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order where those of equal vector and number follow each other, and where each such run begins."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint32 if x.itemsize == 4 else np.uint64)
    factors = np.random.default_rng(11).integers(1, 1 << 62, raw.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(raw), 16384):
        mixed[a : a + 16384] += (raw[a : a + 16384].astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 16384):
        here, before = order[a : a + 16384], order[a - 1 : a + 16384 - 1][: len(order[a : a + 16384])]
        new[a : a + 16384] = (number[here] != number[before]) | (x[here] != x[before]).any(axis=1)
    return order, np.flatnonzero(new)


class NearBlock(ItemBlock):
    """The items of a block, held in id order while query rows stream past; without `counted` totals are left out."""

    def __init__(self, items: pa.Table, scoring: Scoring, gen: int, counted: bool = True) -> None:
        super().__init__(items, scoring, gen)
        self.counted, self.exact = counted, [i for i, c in enumerate(scoring.clauses) if c.kind == "exact"]
        x, valid = self.vectors[gen]
        rows = np.flatnonzero(valid)
        codes = np.array([self.codes[i][0][rows] for i in self.exact]).reshape(len(self.exact), len(rows))
        group = _numbered(list(codes), len(rows))
        self.groups = int(group.max(initial=-1)) + 1
        if not 0 < self.groups <= GROUPS:
            return
        order, starts = _alike(x[rows], group)
        number = np.diff(np.append(starts, len(order)))
        by = np.lexsort((order[starts], group[order[starts]]))  # by group, then by lowest id
        self.ids, self.starts, self.number = rows[order], starts[by], number[by]
        self.least, self.group = self.ids[self.starts], group[order[self.starts]]
        self.x = x[self.least]
        self.cuts = np.searchsorted(self.group, np.arange(self.groups + 1))
        self.values = codes[:, order[self.starts[self.cuts[:-1]]]]
        self.square, self.sides = _squares(self.x), {}

    def _side(self, kind: type, rounding: float) -> np.ndarray:
        """The right side of the product that bounds squared distances, see `_screen`."""
        if kind not in self.sides:
            side = np.empty((len(self.x), self.x.shape[1] + 3), kind)
            side[:, :-3], side[:, -3], side[:, -2], side[:, -1] = self.x, 1, self.square * (1 - rounding), np.sqrt(self.square)
            self.sides[kind] = side
        return self.sides[kind]

    def score(self, q: pa.Table) -> Iterator[pa.Table]:
        if not 0 < self.groups <= GROUPS or q.num_rows * self.items.num_rows < FEW:
            yield from super().score(q)
            return
        step = max(ROWS // self.scoring.keep, 256)
        if q.num_rows > step:
            for a in range(0, q.num_rows, step):
                yield from self.score(q.slice(a, step))
            return
        clause = self.scoring.clauses[self.gen]
        act, gens, heavy = (q.column(n).to_numpy() for n in ("act", "gens", "heavy"))
        v, given = _matrix(q.column(f"v{self.scoring.slot(self.gen)}"))
        rows = np.flatnonzero(given & ((act >> self.gen) & 1 == 1))
        _same_dimension(v[rows], self.x)
        if not len(rows):
            return
        codes = np.array([_codes_in(q.column(f"t{self.scoring.slot(i)}"), self.codes[i]) for i in self.exact]).reshape(len(self.exact), len(act))
        base = np.stack(q.column("base").to_numpy()) if self.exact else np.zeros((len(act), 0))
        profile = _numbered([c[rows] for c in (act, gens, heavy, *codes, *base.T)], len(rows))
        order, starts = _alike(v[rows], profile)
        by = np.argsort(profile[order[starts]], kind="stable")
        sizes = np.diff(np.append(starts, len(order)))
        who = rows[order[starts[by]]]  # a row for each kind of query, by profile
        kind_of = np.empty(len(starts), np.int64)
        kind_of[by] = np.arange(len(by))
        member = np.empty(len(rows), np.int64)
        member[order] = np.repeat(kind_of, sizes)
        cuts = np.flatnonzero(np.diff(profile[order[starts[by]]], prepend=-1))
        side = self._left(v[who], clause.min_score)
        picked, counts = [], np.zeros(len(who), np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(who)]):
            at = who[a]
            found, counts[a:b] = self._profile(v[who[a:b]], side[0][a:b], side[1:], act[at], gens[at], heavy[at], codes[:, at], base[at])
            picked.append((found[0] + a, *found[1:]))
        r, c, score, hits, bases = (np.concatenate(part) for part in zip(*picked))
        # what a kind of query found is found by each row of it
        first = np.searchsorted(r, np.arange(len(who) + 1))
        many = (first[1:] - first[:-1])[member]
        at = np.repeat(first[member] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        totals = np.zeros(q.num_rows, np.int64)
        totals[rows] = counts[member]
        for a in range(0, max(len(at), 1), 1 << 18):  # bounds an array of bases
            some = slice(a, a + (1 << 18))
            yield _result(q, self.items, (np.repeat(rows, many)[some], c[at[some]], score[at[some]], hits[at[some]], bases[at[some]]), totals if a == 0 else np.zeros_like(totals))

    def _left(self, v: np.ndarray, least: float) -> tuple:
        """The left side of the product that bounds squared distances from below, the right side, and how far above it they may be."""
        square = _squares(v)
        widest = np.sqrt(square.max(initial=0.0)) + np.sqrt(self.square.max(initial=0.0))
        kind, rounding = np.float64, 0.0
        for kind in (np.float32, np.float64):
            rounding = 2 * (v.shape[1] + 8) * float(np.finfo(kind).eps)
            if rounding * widest * widest <= (1.0 / least - 1.0) / 32:
                break
        left = np.empty((len(v), v.shape[1] + 3), kind)
        left[:, :-3], left[:, -3], left[:, -2], left[:, -1] = v, square * (1 - rounding), 1, np.sqrt(square) * (-2 * rounding)
        left[:, :-3] *= -2
        return left, self._side(kind, rounding), 2.1 * rounding * widest * widest

    def _profile(self, v: np.ndarray, left: np.ndarray, side: tuple, act: int, gens: int, heavy: int, codes: np.ndarray, base: np.ndarray) -> tuple:
        """Kept rows (query, item, score, hits, bases) and numbers of matches of queries that differ in their vectors only."""
        clauses, gen, keep, groups = self.scoring.clauses, self.gen, self.scoring.keep, self.groups
        points, hit = np.zeros((len(clauses), groups)), np.zeros((len(clauses), groups), bool)
        required, must_on = np.ones(groups, bool), False
        optional, group_required, group_optional = np.zeros(groups, np.int64), np.ones(groups, bool), np.zeros(groups, np.int64)
        group_any, taken = np.zeros(groups, bool), np.zeros(groups, bool)
        for i, clause in enumerate(clauses):
            active = bool(act >> i & 1)
            if i == gen:
                hit[i] = True
            elif active:
                slot = self.scoring.slot(i)
                hit[i] = self.values[slot] == codes[slot]
                points[i] = np.where(hit[i], base[slot], 0.0)
            in_group = hit[i] & bool(heavy >> i & 1)
            group_any |= in_group
            if clause.occur == "must":
                required &= hit[i] | (not active)
                group_required &= in_group | (not active)
                must_on |= active
            else:
                optional += hit[i]
                group_optional += in_group
            if i < gen and gens >> i & 1:
                taken |= hit[i]
        matched = required & (optional >= self.scoring.min_should) & ~taken
        counted = matched & ~(group_any & group_required & (group_optional >= self.scoring.min_should))
        exact = sum((points[i] * c.weight for i, c in enumerate(clauses) if i != gen), np.zeros(groups))
        level = np.round(exact, DIGITS)
        best, combo = np.full((len(v), keep), -np.inf), np.full((len(v), keep), -1, np.int64)
        sims, counts = np.zeros((len(v), keep)), np.zeros(len(v), np.int64)
        state = best, combo, sims
        for value in np.unique(level[matched])[::-1]:
            some = np.flatnonzero(matched & (level == value))
            xs = np.concatenate([np.arange(self.cuts[g], self.cuts[g + 1]) for g in some])
            number = np.where(counted[self.group[xs]], self.number[xs], 0) if self.counted else None
            if number is not None and not number.any():
                number = None
            for b in range(0, len(xs), WIDTH):
                part, n = xs[b : b + WIDTH], None if number is None else number[b : b + WIDTH]
                right = side[0][part].T
                step = max(TILE // len(part), 1)
                for a in range(0, len(v), step):
                    self._tile(np.arange(a, min(a + step, len(v))), part, n, v, left, right, side[1], exact, points, state, counts)
        return self._rows(state, points, hit), counts

    def _last(self, state: tuple, qs: np.ndarray) -> np.ndarray:
        """The score that a row has to reach to come in: that of the row with which `keep` are known."""
        best, combo, _ = state
        known = np.cumsum(np.where(combo[qs] >= 0, self.number[combo[qs]], 0), axis=1) >= self.scoring.keep
        place = known.argmax(axis=1)
        return np.where(known.any(axis=1), best[qs, place], -np.inf)

    def _tile(self, qs, xs, number, v, left, right, error, exact, points, state, counts) -> None:
        clause, keep = self.scoring.clauses[self.gen], self.scoring.keep
        most = exact[self.group[xs]].max()

        def limits(rows: np.ndarray) -> np.ndarray:
            """The greatest squared distances with which items here can come in; -1 for none."""
            lacks = self._last(state, rows) - _SLACK - most
            asked = np.maximum(lacks / clause.weight, clause.min_score) if clause.weight > 0 else np.where(lacks > 0, 2.0, clause.min_score)
            return np.where(asked > 1 + 1e-9, -1.0, np.maximum(1.0 / (asked - 1e-11) - 1.0, 0.0))

        if number is None:
            qs = qs[limits(qs) >= 0]
            if not len(qs):
                return
        apart = left[qs] @ right  # at most the squared distance, and less than `error` below it
        if number is not None:
            sure = apart <= 1.0 / (clause.min_score + 1e-11) - 1.0 - error
            bits = np.packbits(sure, axis=1)
            for d in range(int(number.max()).bit_length()):
                digit = np.packbits(number >> d & 1 == 1)
                counts[qs] += (1 << d) * np.bitwise_count(bits & digit).sum(axis=1, dtype=np.int64)
            r, c = np.nonzero((apart <= 1.0 / (clause.min_score - 1e-11) - 1.0) & ~sure)
            near = _pair_similarity(v, self.x, qs[r], xs[c]) >= clause.min_score
            np.add.at(counts, qs[r[near]], number[c[near]])
            live = limits(qs) >= 0
            qs, apart = qs[live], apart[live]
            if not len(qs):
                return
        near = apart <= limits(qs)[:, None]
        if len(xs) > keep and np.count_nonzero(near) > 8 * keep * len(qs):
            # the nearest first: they raise what the others have to reach
            first = np.argpartition(apart, keep - 1, axis=1)[:, :keep]
            self._take(np.repeat(qs, keep), xs[first.reshape(-1)], v, points, state)
            near = apart <= limits(qs)[:, None]
        r, c = np.nonzero(near)
        for a in range(0, len(r), 1 << 17):
            self._take(qs[r[a : a + (1 << 17)]], xs[c[a : a + (1 << 17)]], v, points, state)

    def _take(self, q: np.ndarray, x: np.ndarray, v: np.ndarray, points: np.ndarray, state: tuple) -> None:
        """The best rows of those known and some pairs."""
        best, combo, sims = state
        sim, score = _pair_similarity(v, self.x, q, x), np.zeros(len(q))
        for i, c in enumerate(self.scoring.clauses):
            score += (sim if i == self.gen else points[i, self.group[x]]) * c.weight
        score = np.round(score, DIGITS)
        fits = np.flatnonzero((sim >= self.scoring.clauses[self.gen].min_score) & (score >= best[q, -1]))
        if not len(fits):
            return
        who = np.unique(q[fits])
        q = np.concatenate([np.repeat(who, best.shape[1]), q[fits]])
        x = np.concatenate([combo[who].reshape(-1), x[fits]])
        score = np.concatenate([best[who].reshape(-1), score[fits]])
        sim = np.concatenate([sims[who].reshape(-1), sim[fits]])
        order = np.lexsort((self.least[x], -score, q))
        order = order[x[order] >= 0]
        q, x, score, sim = q[order], x[order], score[order], sim[order]
        fresh = np.ones(len(q), bool)  # the nearest are met again
        fresh[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
        q, x, score, sim = q[fresh], x[fresh], score[fresh], sim[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < best.shape[1]
        at = q[kept], place[kept]
        best[who], combo[who] = -np.inf, -1
        best[at], combo[at], sims[at] = score[kept], x[kept], sim[kept]

    def _rows(self, state: tuple, points: np.ndarray, hit: np.ndarray) -> tuple:
        """The best items, from the best kinds of items."""
        best, combo, sims = state
        keep = self.scoring.keep
        r, place = np.nonzero((combo >= 0) & (best >= self._last(state, np.arange(len(best)))[:, None]))
        x, score, sim = combo[r, place], best[r, place], sims[r, place]
        many = np.minimum(self.number[x], keep)
        at = np.repeat(self.starts[x] - np.concatenate(([0], np.cumsum(many)[:-1])) if len(x) else many, many) + np.arange(many.sum())
        r, x, score, sim, c = np.repeat(r, many), np.repeat(x, many), np.repeat(score, many), np.repeat(sim, many), self.ids[at]
        order = np.lexsort((c, -score, r))
        order = order[np.arange(len(order)) - np.searchsorted(r[order], r[order]) < keep]
        r, x, score, sim, c = r[order], x[order], score[order], sim[order], c[order]
        group = self.group[x]
        bases = points[:, group].T.copy()
        bases[:, self.gen] = sim
        bits = sum((hit[i, group].astype(np.int64) << i for i in range(len(hit))), np.zeros(len(r), np.int64))
        return r, c, score, bits, bases
