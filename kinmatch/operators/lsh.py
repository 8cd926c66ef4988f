"""Approximate radial joins: rows that lie near each other fall into equal buckets of some hash table.

A table hashes a vector by several random projections (p-stable hashing, Datar et al. 2004), each cut into intervals whose
width follows from the similarity asked for: `width` times the greatest distance that still matches. Items have one
bucket in each table. Queries also visit neighbouring buckets (multi-probe hashing, Lv et al. 2007): those that they reach
by crossing the nearer border of one or more intervals, if the squares of the distances to these borders, as
shares of the interval, add up to at most `probe`.

Directions are integers from a fixed rule, so that any engine can rebuild the buckets. Pairs that meet in several tables are
judged in the first, so nothing is repeated and counts stay right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the directions: a factor each for table, projection and component, a prime, and the greatest size.
DIRECTION_FACTORS = (7919, 104729, 611953)
DIRECTION_PRIME = 2147483647
DIRECTION_LIMIT = 1000
#: Standard deviation of the integers from -DIRECTION_LIMIT to DIRECTION_LIMIT.
DIRECTION_SCALE = (DIRECTION_LIMIT * (DIRECTION_LIMIT + 1) / 3) ** 0.5


@dataclass(frozen=True)
class Lsh:
    tables: int = 8
    projections: int = 8
    width: float = 2.0  # of an interval, in greatest matching distances
    probe: float = 0.05  # neighbouring buckets that queries visit; 0: none

    def __post_init__(self):
        if not (self.tables >= 1 and 1 <= self.projections <= 12 and self.width > 0 and self.probe >= 0):
            raise ValueError(f"bad hashing options {self}")

    def numbers(self, components: np.ndarray) -> np.ndarray:
        """Pseudo-random integers by table, projection and component: remainders of squares modulo a prime."""
        a, b, c = DIRECTION_FACTORS
        t, p = np.arange(self.tables)[:, None, None], np.arange(self.projections)[None, :, None]
        h = (t * a + p * b + components[None, None, :] * c) % DIRECTION_PRIME
        return (h * h) % DIRECTION_PRIME

    def places(self, x: np.ndarray, min_score: float) -> np.ndarray:
        """Projections of the rows of x in intervals, by row, table and projection. The offset is the rule's component 0."""
        directions = self.numbers(np.arange(1, x.shape[1] + 1)) % (2 * DIRECTION_LIMIT + 1) - DIRECTION_LIMIT
        offsets = self.numbers(np.zeros(1, np.int64))[:, :, 0] % DIRECTION_LIMIT / DIRECTION_LIMIT
        width = DIRECTION_SCALE * self.width * max(reach(min_score), 1e-6)
        return np.einsum("nd,tpd->ntp", x, directions.astype(float)) / width + offsets

    @cached_property
    def subsets(self) -> np.ndarray:
        """Every subset of the projections as a row of 0 and 1."""
        n = self.projections
        return (np.arange(1 << n)[:, None] >> np.arange(n)[None, :]) & 1

    def meeting(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """By pair and table, whether query places q visit the bucket of item places x."""
        home, share = np.floor(q), q - np.floor(q)
        step = np.floor(x) - home
        crossed = np.where(share < 0.5, share, 1 - share)
        near = (step == 0) | (step == np.where(share < 0.5, -1, 1))
        return near.all(axis=2) & (np.where(step == 0, 0, crossed * crossed).sum(axis=2) <= self.probe)

    def judged_here(self, table: int, min_score: float) -> Callable:
        """Which row pairs (r, c) of q and x meet in `table` and in none before it."""

        def first(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
            out = np.zeros(r.size, bool)
            qs, q_at = np.unique(r, return_inverse=True)
            xs, x_at = np.unique(c, return_inverse=True)
            placed = self.places(q[qs], min_score)[:, : table + 1], self.places(x[xs], min_score)[:, : table + 1]
            for a in range(0, r.size, 16384):
                meets = self.meeting(placed[0][q_at[a : a + 16384]], placed[1][x_at[a : a + 16384]])
                out[a : a + 16384] = meets[:, table] & ~meets[:, :table].any(axis=1)
            return out

        return first


def reach(min_score: float) -> float:
    """The greatest distance of two vectors whose similarity 1 / (1 + d * d) is at least `min_score`."""
    return (1.0 / min_score - 1.0) ** 0.5


def _names(buckets: np.ndarray) -> np.ndarray:
    """One 64-bit number for the last axis of interval numbers. Equal numbers of different buckets only cost comparisons."""
    out = np.zeros(buckets.shape[:-1], np.uint64)
    for k in range(buckets.shape[-1]):
        out = (out ^ buckets[..., k].astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def buckets(vector: Column, lsh: Lsh, min_score: float, probing: bool) -> Column:
    """array<struct<_table, _bucket>>: the bucket of a vector in every table, or those that a query visits."""

    @F.pandas_udf("array<struct<_table: int, _bucket: bigint>>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for start in range(0, len(s), 256):  # bounds the table of subsets
                place = lsh.places(np.stack(s.iloc[start : start + 256].to_numpy()).astype(float), min_score)
                home = np.floor(place)
                if not probing:
                    names = _names(home)
                    out += [[{"_table": t, "_bucket": int(b)} for t, b in enumerate(row)] for row in names]
                    continue
                share = place - home
                crossed, side = np.minimum(share, 1 - share) ** 2, np.where(share < 0.5, -1, 1)
                row, table, subset = np.nonzero(crossed @ lsh.subsets.T <= lsh.probe)
                names = _names(home[row, table] + side[row, table] * lsh.subsets[subset])
                cuts = np.searchsorted(row, np.arange(len(place) + 1))
                pairs = [{"_table": int(t), "_bucket": int(b)} for t, b in zip(table, names)]
                out += [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.Series(out, dtype=object)

    return hashed(vector)


def add_buckets(q: DataFrame, items: DataFrame, vector: str, min_score: float, lsh: Lsh) -> tuple[DataFrame, DataFrame]:
    """Both sides with _table and _bucket: a row for each bucket that an item is in, or a query visits."""
    q, items = (df.select("*", F.inline(buckets(F.col(vector), lsh, min_score, probing))) for df, probing in ((q, True), (items, False)))
    return q, items
