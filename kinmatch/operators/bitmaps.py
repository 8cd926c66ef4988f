"""The best item combinations of each query combination, and its totals, from bitmaps of the items that share a value.

A task holds items, in order of their lowest id, in parts of at most PART rows. A part has a bitmap for each value on a 64th of
its rows or more, and the rows of every rarer value, so it takes no more room than its values. For a query the bitmaps of its
values are added up, 64 items at a time, as binary digits of each item's number of hits. The items with as many hits as asked
for give the total. Of the items, only those with so many hits that they can come before the best ones known are scored; the
first parts are small, so that such best ones are known early. Nothing is estimated: bounds only pass over items that cannot
come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kinmatch.operators.scoring import DIGITS, Scoring, _coded, _codes_in

#: Rows of the first part and of the largest one; each part is GROWTH times as large as the one before.
FIRST, GROWTH, PART = 1 << 15, 4, 1 << 17


def _pack(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little").view(np.uint64)


class _Part:
    """Rows from `start` on, by value."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, start: int) -> None:
        self.codes, self.start = codes, start
        size = codes.shape[1]
        self.flags = np.zeros(-(-size // 64) * 64, np.uint8)
        self.values, self.cuts, self.order, self.dense = [], [], [], []
        for column in codes:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            cuts = np.append(first, size)
            often = np.flatnonzero(np.diff(cuts) >= max(size // 64, 1))
            self.values.append(values)
            self.cuts.append(cuts)
            self.order.append(order.astype(np.int32))
            self.dense.append({int(k): self._of(order[cuts[k] : cuts[k + 1]]) for k in often})
        # numbers of rows by binary digit, so that totals are counts of bits
        self.digits = []
        for k in range(int(n.max()).bit_length()):
            self.flags[:size] = n >> k & 1
            self.digits.append((1 << k, _pack(self.flags)))
        self.flags[:] = 0
        words = len(self.flags) // 64
        self.counts = np.empty((len(codes).bit_length(), words), np.uint64)
        self.spare = np.empty((2, words), np.uint64)

    def _of(self, at: np.ndarray) -> np.ndarray:
        self.flags[at] = 1
        made = _pack(self.flags)
        self.flags[at] = 0
        return made

    def places(self, slot: int, codes: np.ndarray) -> np.ndarray:
        """The places of values among those of the part; -1 for others."""
        at = np.minimum(np.searchsorted(self.values[slot], codes), len(self.values[slot]) - 1)
        return np.where(self.values[slot][at] == codes, at, -1)

    def bitmap(self, slot: int, place: int) -> np.ndarray:
        known = self.dense[slot].get(place)
        return known if known is not None else self._of(self.order[slot][self.cuts[slot][place] : self.cuts[slot][place + 1]])

    def count(self, bitmaps: Iterator[np.ndarray], most: int) -> int:
        """Adds up at most `most` bitmaps; the number of binary digits used."""
        digits = most.bit_length()
        self.counts[:digits] = 0
        for k, carry in enumerate(bitmaps):
            for j in range((k + 1).bit_length()):
                digit, out = self.counts[j], self.spare[j % 2]
                np.bitwise_and(digit, carry, out=out)
                np.bitwise_xor(digit, carry, out=digit)
                carry = out
        return digits

    def at_least(self, hits: int, digits: int, must: np.ndarray | None) -> np.ndarray:
        """The items of all those `must` has (None: any) with so many hits; hits is 0 only with `must`."""
        out = None
        for j in range(digits if hits else 0):
            digit = self.counts[j]
            if hits >> j & 1:
                out = digit if out is None else digit & out
            elif out is not None:
                out = digit | out
        if out is None:
            return must
        return out if must is None else out & must

    def total(self, bits: np.ndarray) -> int:
        return sum(weight * int(np.bitwise_count(bits & digit).sum()) for weight, digit in self.digits)

    @staticmethod
    def rows(bits: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bits)
        word, bit = np.nonzero(np.unpackbits(bits[words].view(np.uint8), bitorder="little").reshape(-1, 64))
        return words[word] * 64 + bit


class HeldCombinations:
    """Item combinations (columns `cols`, n, least, item_id) of a task."""

    def __init__(self, items: pa.Table, scoring: Scoring, cols: list[str], keep: int) -> None:
        items = items.sort_by("least")
        self.items, self.scoring, self.cols, self.keep = items.select(["item_id", "least"]), scoring, cols, keep
        self.known = [_coded(items.column(c)) for c in cols]
        codes = np.stack([np.asarray(k[0], np.int32) for k in self.known])
        n = items.column("n").to_numpy()
        self.parts, start, size = [], 0, FIRST
        while start < len(n):
            some = slice(start, start + size)
            self.parts.append(_Part(np.ascontiguousarray(codes[:, some]), n[some], start))
            start, size = start + size, min(size * GROWTH, PART)

    def score(self, queries: pa.Table) -> pa.Table:
        """For each query the best `keep` combinations by score and lowest id, and how many items match in all."""
        exact = [(slot, i, c) for slot, (i, c) in enumerate((i, c) for i, c in enumerate(self.scoring.clauses) if c.kind == "exact")]
        heavy = queries.column("heavy").to_numpy()
        base = np.stack(queries.column("base").to_numpy())
        codes = [_codes_in(queries.column(c), known) for c, known in zip(self.cols, self.known)]
        totals = np.zeros(len(heavy), np.int64)
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(heavy)
        for part in self.parts:
            places = [part.places(slot, codes[slot]) for slot, _, _ in exact]
            for r, mask in enumerate(heavy.tolist()):
                asked = [(slot, i, c.occur == "must", float(base[r, slot] * c.weight), int(places[slot][r])) for slot, i, c in exact if mask >> i & 1]
                totals[r], best[r] = self._one(part, asked, totals[r], best[r])
        sizes = [len(b[0]) for b in best]
        points, at, hits = (np.concatenate(x) for x in zip(*best))
        who = np.flatnonzero(totals)
        none = lambda kind: pa.nulls(len(who), kind)
        made = [
            queries.column("query_id").take(pa.array(np.concatenate([np.repeat(np.arange(len(heavy)), sizes), who]))),
            pa.chunked_array([*self.items.column("item_id").take(pa.array(at)).chunks, none(pa.int64())]),
            pa.chunked_array([*self.items.column("least").take(pa.array(at)).chunks, none(self.items.schema.field("least").type)]),
            pa.chunked_array([pa.array(points), none(pa.float64())]),
            pa.chunked_array([pa.array(hits), none(pa.int64())]),
            pa.chunked_array([pa.nulls(len(at), pa.int64()), pa.array(totals[who])]),
        ]
        return pa.table(made, names=["query_id", "combination", "least", "score", "hits", "n"])

    def _one(self, part: _Part, asked: list[tuple], total: int, best: tuple) -> tuple[int, tuple]:
        """A query (slot, clause, required, points, place in the part) against a part, with what it found before."""
        required = [a for a in asked if a[2]]
        here = [a for a in asked if a[4] >= 0]
        optional = [a for a in here if not a[2]]
        wanted = self.scoring.min_should if required else max(self.scoring.min_should, 1)
        if len(optional) < wanted or any(a[4] < 0 for a in required):
            return total, best
        must = None
        for slot, _, _, _, place in required:
            bits = part.bitmap(slot, place)
            must = bits if must is None else must & bits
        digits = part.count((part.bitmap(slot, place) for slot, _, _, _, place in optional), len(optional))
        total += part.total(part.at_least(wanted, digits, must))
        sure, points = sum(a[3] for a in required), [a[3] for a in optional]
        least, done = self._hits_needed(sure, points, best[0], 0.4), None
        if least is not None:  # items with the most hits first: they raise what the others have to reach
            for hits in range(len(optional), max(least, wanted), -1):
                done = part.at_least(hits, digits, must)
                if np.bitwise_count(done).sum() >= self.keep:
                    best = self._with(part, part.rows(done), here, best)
                    least = self._hits_needed(sure, points, best[0], -1.0)
                    break
            else:
                done = None
        if least is not None:
            bits = part.at_least(max(least, wanted), digits, must)
            best = self._with(part, part.rows(bits if done is None else bits & ~done), here, best)
        return total, best

    def _with(self, part: _Part, at: np.ndarray, here: list[tuple], best: tuple) -> tuple:
        """The best rows so far and of those at some rows of a part."""
        if not len(at):
            return best
        values = np.array([part.values[slot][place] for slot, _, _, _, place in here])
        hit = part.codes[np.array([a[0] for a in here])[:, None], at] == values[:, None]
        # points are added up one by one, in the order of the clauses
        points = np.round(np.cumsum(np.where(hit, np.array([a[3] for a in here])[:, None], 0.0), axis=0)[-1], DIGITS)
        if len(points) > self.keep:
            some = np.flatnonzero(points >= np.partition(points, -self.keep)[-self.keep])
            at, points, hit = at[some], points[some], hit[:, some]
        hits = (hit.astype(np.int64) << np.array([a[1] for a in here])[:, None]).sum(axis=0)
        points, at, hits = (np.concatenate(x) for x in zip(best, (points, at + part.start, hits)))
        order = np.lexsort((at, -points))[: self.keep]
        return points[order], at[order], hits[order]

    def _hits_needed(self, sure: float, points: list[float], best: np.ndarray, more: float) -> int | None:
        """The least number of optional hits with which an item can reach the last of the best scores known and so many rounded
        digits more; None if it cannot. Items of later parts have higher ids and have to exceed it, by half a digit before it is
        rounded; for those of the same part an equal score may do."""
        if len(best) < self.keep:
            return 0
        reach = sure
        for hits, p in enumerate([0.0, *sorted((max(p, 0.0) for p in points), reverse=True)]):
            reach += p
            if reach >= best[-1] + more * 10.0**-DIGITS:
                return hits
        return None


def score_held(scoring: Scoring, cols: list[str], keep: int, runs):
    """Queries (_side 1) against the items (_side 0) that come first in their block; `runs` cuts batches by block and side."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, held = None, [], None
        for batch in batches:
            for run in runs(batch, ["_block", "_side"]):
                key = run.column("_block")[0].as_py()
                if key != here:
                    here, rows, held = key, [], None
                if run.column("_side")[0].as_py() == 0:
                    rows.append(run.select([*cols, "n", "least", "item_id"]))
                    continue
                if held is None and rows:
                    held, rows = HeldCombinations(pa.Table.from_batches(rows), scoring, cols, keep), []
                if held is not None:
                    yield from held.score(pa.Table.from_batches([run])).to_batches()

    return score
