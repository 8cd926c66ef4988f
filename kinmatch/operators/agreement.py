"""The best item combinations of each query combination, and its totals, by cells of rows that agree.

A cell holds the queries and the items that agree on some fields; the cell of no field holds all. Totals follow by inclusion and
exclusion: an item with h optional hits is in a cell for each subset of them, and the signs of the cells add up to 1 where h is
enough. A cell is split by the values of each later field as long as that costs less than to compare its rows, so cells shrink
by every field they agree on; in the others each pair is compared once, and stands for all cells below. Where nothing tells
rows apart that is every pair of them, never more.

Best rows come out of the same cells. An item whose hits end at a split cell is among that cell's first `keep` by lowest id, or as
many others come before it; any other is met in the compared cell that its first hits lead to. Fields of many points are split
first, so that good rows are known early, and only rows that can come before the best ones known are scored. Nothing is
estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinmatch.operators.scoring import DIGITS, Scoring, _codes_in

#: Queries looked at together and best rows of them all, pairs compared at once, and scored pairs that wait before the best
#: rows are cut.
CHUNK, ROWS, TILE, WAITING = 1 << 18, 1 << 22, 1 << 18, 1 << 16
#: A cell with fewer comparisons of values is not split; what a further cell costs, in comparisons, and a row to split.
WHOLE, CELL, ROW = 1 << 20, 1 << 18, 1 << 6
_SLACK = 2.0 * 10.0**-DIGITS


def _signs(wanted: int, fields: int) -> list[int]:
    """What a cell of s fields adds for each of its items, so that all cells together count items with `wanted` hits."""
    return [sum(comb(s, u) * (-1) ** (s - u) for u in range(wanted, s + 1)) for s in range(fields + 1)]


def _groups(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, rows by value in their order, and where each value begins and the last one ends."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    cuts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))
    return codes[cuts[:-1]] if len(codes) else codes, rows[order], cuts


class HeldCells:
    """Item combinations (columns `cols`, n, least, item_id) of a task."""

    def __init__(self, tables: Iterable[pa.Table], scoring: Scoring, cols: list[str], keep: int) -> None:
        self.scoring, self.cols, self.keep = scoring, cols, keep
        found, coded, rest = [{} for _ in cols], [], []
        for table in tables:
            codes = []
            for known, c in zip(found, cols):
                column = pc.dictionary_encode(pa.concat_arrays(table.column(c).cast(pa.string()).chunks))
                places = np.array([known.setdefault(v, len(known)) for v in column.dictionary.to_pylist()], np.int32)
                codes.append(places[column.indices.to_numpy(zero_copy_only=False)])
            coded.append(np.stack(codes).astype(np.min_scalar_type(max(len(known) for known in found))))
            rest.append(table.select(["item_id", "least", "n"]))
        items = pa.concat_tables(rest)
        order = pc.sort_indices(items, sort_keys=[("least", "ascending")])
        items = items.take(order)
        self.items = items.select(["item_id", "least"])
        self.known = [(None, pa.array(list(known), pa.string())) for known in found]
        widest = max(len(known) for known in found)
        self.kind = next((t for t in (np.uint8, np.uint16) if widest < np.iinfo(t).max - 1), np.int32)
        self.none = np.iinfo(self.kind).max  # a query without the field, or with a value that no item has
        self.codes = np.concatenate([part.astype(self.kind) for part in coded], axis=1)[:, order.to_numpy()]
        self.n = items.column("n").to_numpy()
        self.exact = [(i, c) for i, c in enumerate(scoring.clauses) if c.kind == "exact"]

    def score(self, queries: pa.Table) -> pa.Table:
        """For each query the best `keep` combinations by score and lowest id, and how many items match in all. Points are not
        negative."""
        chunk = max(min(CHUNK, ROWS // self.keep), 1)
        parts = [_Asked(self, queries.slice(a, chunk)).found() for a in range(0, queries.num_rows, chunk)]
        return pa.concat_tables(parts)


class _Asked:
    """Some queries against the held items."""

    def __init__(self, held: HeldCells, queries: pa.Table) -> None:
        self.held, self.queries, count = held, queries, queries.num_rows
        heavy, base = queries.column("heavy").to_numpy(), np.stack(queries.column("base").to_numpy())
        on = np.array([(heavy >> i) & 1 == 1 for i, _ in held.exact])
        codes = [_codes_in(queries.column(c), known) for c, known in zip(held.cols, held.known)]
        self.codes = np.stack([np.where(a & (c >= 0), c, held.none) for a, c in zip(on, codes)]).astype(held.kind)
        self.points = np.stack([np.where(a, base[:, slot] * c.weight, 0.0) for slot, (a, (_, c)) in enumerate(zip(on, held.exact))])
        self.heavy, self.keep = heavy, held.keep
        self.totals = np.zeros(count, np.int64)
        self.best = np.full((count, self.keep), -np.inf)
        self.rows, self.hits = np.full((count, self.keep), -1, np.int32), np.zeros((count, self.keep), np.int64)
        self.waiting, self.waits = [], 0

    def found(self) -> pa.Table:
        held, must = self.held, sum(1 << i for i, c in self.held.exact if c.occur == "must")
        for mask in np.unique(self.heavy & must).tolist():
            required = [slot for slot, (i, _) in enumerate(held.exact) if mask >> i & 1]
            optional = [slot for slot, (i, c) in enumerate(held.exact) if c.occur != "must"]
            asked = np.flatnonzero((self.heavy & must) == mask)
            self.order = sorted(optional, key=lambda slot: -self.points[slot, asked].sum() / max(np.count_nonzero(self.points[slot, asked]), 1))
            self.wanted = held.scoring.min_should if required else max(held.scoring.min_should, 1)
            self.sign = _signs(self.wanted, len(optional))
            self.sure = self.points[required].sum(axis=0)
            self._required(asked, np.arange(len(held.n), dtype=np.int32), required)
        self._cut()
        given = self.rows >= 0
        who, at = np.flatnonzero(self.totals), self.rows[given]
        none = lambda kind: pa.nulls(len(who), kind)
        made = [
            self.queries.column("query_id").take(pa.array(np.concatenate([np.repeat(np.arange(len(given)), given.sum(axis=1)), who]))),
            pa.chunked_array([*held.items.column("item_id").take(pa.array(at)).chunks, none(pa.int64())]),
            pa.chunked_array([*held.items.column("least").take(pa.array(at)).chunks, none(held.items.schema.field("least").type)]),
            pa.chunked_array([pa.array(self.best[given]), none(pa.float64())]),
            pa.chunked_array([pa.array(self.hits[given]), none(pa.int64())]),
            pa.chunked_array([pa.nulls(len(at), pa.int64()), pa.array(self.totals[who])]),
        ]
        return pa.table(made, names=["query_id", "combination", "least", "score", "hits", "n"])

    def _required(self, qs: np.ndarray, xs: np.ndarray, slots: list[int]) -> None:
        """The cells of rows that agree on all required fields."""
        if not slots:
            self._cell(qs, xs, 0, 0, 0, self.sure[qs])
            return
        for q, x in self._split(slots[0], qs, xs):
            self._required(q, x, slots[1:])

    def _split(self, slot: int, qs: np.ndarray, xs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Queries and items by their common value."""
        asked = self.codes[slot, qs]
        given = asked != self.held.none
        values, qs, ends = _groups(asked[given], qs[given])
        others, xs, cuts = _groups(self.held.codes[slot, xs], xs)
        _, a, b = np.intersect1d(values, others, assume_unique=True, return_indices=True)
        return [(qs[ends[i] : ends[i + 1]], xs[cuts[j] : cuts[j + 1]]) for i, j in zip(a.tolist(), b.tolist())]

    def _cell(self, qs: np.ndarray, xs: np.ndarray, s: int, k: int, path: int, sure: np.ndarray) -> None:
        """Queries and items that agree on s optional fields before place k of the order, `path` as bits of places; the queries'
        points for these and the required ones are `sure`."""
        left = len(self.order) - k
        compared = len(qs) * len(xs) * (left + 1)
        if compared <= WHOLE or (len(qs) + len(xs)) * left * ROW >= compared:
            self._compare(qs, xs, s, k, path, sure)
            return
        below, cost = [], (len(qs) + len(xs)) * left * ROW
        for j in range(k, len(self.order)):
            some = self._split(self.order[j], qs, xs)
            below.append(some)
            cost += sum(len(q) * len(x) * (len(self.order) - j) + CELL for q, x in some)
            if cost >= compared:
                self._compare(qs, xs, s, k, path, sure)
                return
        self.totals[qs] += self.sign[s] * int(self.held.n[xs].sum())
        if s >= self.wanted:
            places = np.flatnonzero(sure >= self.best[qs, -1] - _SLACK)
            first = xs[: self.keep]
            if len(places):
                self._take(np.repeat(qs[places], len(first)), np.tile(first, len(places)))
        for j, some in enumerate(below, k):
            for q, x in some:  # queries are in order in every cell
                self._cell(q, x, s + 1, j + 1, path | 1 << j, sure[np.searchsorted(qs, q)] + self.points[self.order[j], q])

    def _compare(self, qs: np.ndarray, xs: np.ndarray, s: int, k: int, path: int, sure: np.ndarray) -> None:
        """Every pair of the cell."""
        slots = self.order[k:]
        # what a pair with r further hits adds to the total, for itself and for all cells below
        adds = [sum(comb(r, j) * self.sign[s + j] for j in range(r + 1)) for r in range(len(slots) + 1)]
        counted = [r for r, add in enumerate(adds) if add]
        asked = self.codes[np.array(slots, int)[:, None], qs]
        used = [j for j in range(len(slots)) if (asked[j] != self.held.none).any()]
        rest = sum((self.points[slots[j], qs] for j in used), np.zeros(len(qs)))
        width = min(-(-len(xs) // 64) * 64, 8192)
        for c in range(0, len(xs), width):
            some = xs[c : c + width]
            pad = -(-len(some) // 64) * 64
            items = np.full((len(slots), pad), self.held.none - 1, self.held.kind)
            items[:, : len(some)] = self.held.codes[np.array(slots, int)[:, None], some]
            digits, n = [], np.zeros(pad, np.int64)
            n[: len(some)] = self.held.n[some]
            for d in range(int(n.max()).bit_length()):
                digits.append((1 << d, np.packbits(n >> d & 1, bitorder="little").view(np.uint64)))
            step = max(TILE // pad, 1)
            live = (sure + rest >= self.best[qs, -1] - _SLACK) & (s + len(used) >= self.wanted)
            for a in range(0, len(qs), step):
                part = slice(a, a + step)
                r = np.zeros((len(qs[part]), pad), np.uint8)
                same = np.empty(r.shape, bool)
                for j in used:
                    np.equal(asked[j, part, None], items[j], out=same)
                    np.add(r, same.view(np.uint8), out=r)
                for hits in counted:
                    bits = np.packbits(r == hits, axis=1, bitorder="little").view(np.uint64)
                    for weight, digit in digits:
                        self.totals[qs[part]] += adds[hits] * weight * np.bitwise_count(bits & digit).sum(axis=1, dtype=np.int64)
                if live[part].any():
                    at = np.flatnonzero(live[part])
                    self._candidates(qs[part][at], some, asked[:, part][:, at], items, k, path, sure[part][at], used)

    def _candidates(self, qs: np.ndarray, xs: np.ndarray, asked: np.ndarray, items: np.ndarray, k: int, path: int, sure: np.ndarray, used: list[int]) -> None:
        """Scores the pairs that can come before the best ones known. Points of hits are added up as whole numbers of a unit that
        is small enough for one byte, and rounded up, so no pair is lost."""
        points = self.points[np.array([self.order[k + j] for j in used], int)[:, None], qs]
        unit = points.sum(axis=0) / (254 - len(used))
        unit[unit <= 0] = 1.0
        made, one = np.zeros((len(qs), items.shape[1]), np.uint8), np.empty((len(qs), items.shape[1]), np.uint8)
        for j, p in zip(used, np.ceil(points / unit).astype(np.uint8)):
            np.equal(asked[j, :, None], items[j], out=one.view(bool))
            np.multiply(one, p[:, None], out=one)
            np.add(made, one, out=made)
        made = made[:, : len(xs)]

        def enough() -> np.ndarray:
            return made >= np.clip(np.floor((self.best[qs, -1] - _SLACK - sure) / unit), 0, 255).astype(np.uint8)[:, None]

        fits = enough()
        if made.shape[1] > self.keep and np.count_nonzero(fits) > 8 * self.keep * len(qs):
            # the best items of each query first: they raise what the others have to reach
            best = np.argpartition(made, made.shape[1] - self.keep, axis=1)[:, -self.keep :]
            self._take(np.repeat(qs, self.keep), xs[best.reshape(-1)], k, path)
            self._cut()
            fits = enough()
        row, at = np.nonzero(fits)
        for a in range(0, len(row), 4 * WAITING):
            self._take(qs[row[a : a + 4 * WAITING]], xs[at[a : a + 4 * WAITING]], k, path)

    def _take(self, q: np.ndarray, x: np.ndarray, k: int = 0, path: int | None = None) -> None:
        """Scores pairs that match; with `path` only those whose hits before place k of the order are these."""
        for j in range(k if path is not None else 0):
            if not path >> j & 1:
                fits = np.flatnonzero(self.codes[self.order[j], q] != self.held.codes[self.order[j], x])
                q, x = q[fits], x[fits]
        hit = np.array([self.codes[slot, q] == self.held.codes[slot, x] for slot in range(len(self.held.exact))])
        # points are added up one by one, in the order of the clauses
        score, bits, optional = np.zeros(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for slot, (i, c) in enumerate(self.held.exact):
            score += np.where(hit[slot], self.points[slot, q], 0.0)
            bits |= hit[slot].astype(np.int64) << i
            optional += hit[slot] & (c.occur != "must")
        score = np.round(score, DIGITS)
        fits = np.flatnonzero((optional >= self.wanted) & (score >= self.best[q, -1]))
        if len(fits):
            self.waiting.append((q[fits], x[fits], score[fits], bits[fits]))
            self.waits += len(fits)
            if self.waits > WAITING:
                self._cut()

    def _cut(self) -> None:
        """The best rows of those known and those that wait."""
        if not self.waiting:
            return
        q, x, score, bits = (np.concatenate(part) for part in zip(*self.waiting))
        self.waiting, self.waits = [], 0
        who = np.unique(q)
        known = np.repeat(who, self.keep), self.rows[who].reshape(-1), self.best[who].reshape(-1), self.hits[who].reshape(-1)
        q, x, score, bits = (np.concatenate(part) for part in zip(known, (q, x, score, bits)))
        order = np.lexsort((x, -score, q))
        order = order[x[order] >= 0]
        q, x, score, bits = q[order], x[order], score[order], bits[order]
        fresh = np.ones(len(q), bool)  # the first items of a cell may come from several cells
        fresh[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
        q, x, score, bits = q[fresh], x[fresh], score[fresh], bits[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.keep
        at = q[kept], place[kept]
        self.rows[who], self.best[who] = -1, -np.inf
        self.rows[at], self.best[at], self.hits[at] = x[kept], score[kept], bits[kept]


def pack(cols: list[str], runs: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Item combinations as few rows (_pi, packed) of many combinations each, with values as numbers: they are copied to all tasks
    that compare queries with part `_pi` of the items."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, ["_pi"]):
                made = {c: run.column(c).dictionary_encode() for c in cols} | {c: run.column(c) for c in ("n", "least", "item_id")}
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.table(made).schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_table(pa.table(made))
                yield pa.record_batch([run.column("_pi")[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_pi", "packed"])

    return packed


def score_packed(scoring: Scoring, cols: list[str], keep: int, runs: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (_side 1) against the packed items (_side 0) that come first in their block; `runs` cuts batches by block and side."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, held, asked, waits = None, [], None, [], 0

        def answered() -> Iterator[pa.RecordBatch]:
            if asked and held is not None:
                yield from held.score(pa.Table.from_batches(asked)).to_batches()

        for batch in batches:
            for run in runs(batch, ["_block", "_side"]):
                key = run.column("_block")[0].as_py()
                if key != here:
                    yield from answered()
                    here, rows, held, asked, waits = key, [], None, [], 0
                if run.column("_side")[0].as_py() == 0:
                    rows += [b.as_buffer() for b in run.column("packed")]
                    continue
                if held is None and rows:
                    held, rows = HeldCells((pa.ipc.open_stream(b).read_all() for b in rows), scoring, cols, keep), []
                asked.append(run.select(["query_id", "heavy", "base", *cols]))
                waits += run.num_rows
                if waits >= CHUNK:
                    yield from answered()
                    asked, waits = [], 0
        yield from answered()

    return score
