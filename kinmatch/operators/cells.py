"""Metric cells: an exact way to skip far pairs in a radial join.

Every item belongs to the cell of its nearest pivot. For a query at distance r or less from an item of
cell c, the triangle inequality gives two necessary conditions, so the query only visits cells that meet
both:

* ball:   d(query, pivot_c) - r <= radius_c, the greatest item distance in the cell;
* plane:  d(query, pivot_c)^2 - d(query, nearest pivot)^2 <= 2 r d(pivot_c, nearest pivot).

Pivots are a bounded sample (at most `MAX_PIVOTS` vectors), so they travel inside the task closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 1024
_SLACK = 1e-6  # relative, against rounding


def choose_pivots(items: DataFrame, vector: str, count: int) -> np.ndarray:
    """A repeatable pseudo-random sample of `count` distinct item vectors."""
    count = min(count, MAX_PIVOTS)
    sample = items.select("item_id", vector).orderBy(F.xxhash64("item_id"), "item_id").limit(count).select(vector)
    rows = [np.asarray(row[0], dtype=np.float64) for row in sample.collect()]
    return np.unique(np.stack(rows), axis=0)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def nearest_cell(vector: Column, pivots: np.ndarray) -> Column:
    """struct<cell, distance> of the nearest pivot."""

    @F.pandas_udf("struct<cell: int, distance: double>")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            d = _distances(np.stack(s.to_numpy()).astype(np.float64), pivots) if len(s) else np.zeros((0, 1))
            cell = d.argmin(1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "distance": d[np.arange(len(d)), cell]})

    return assign(vector)


def visited_cells(vector: Column, pivots: np.ndarray, radii: np.ndarray, reach: float) -> Column:
    """array<int>: the cells that can hold an item within `reach` of the vector. Cells without items
    have radius -inf and are never visited."""
    apart = _distances(pivots, pivots)
    widest = np.sqrt((pivots * pivots).sum(1).max())

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(s):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(s.to_numpy()).astype(np.float64)
            d = _distances(x, pivots)
            home = d.argmin(1)
            near = d[np.arange(len(d)), home]
            scale = 1.0 + widest + np.sqrt((x * x).sum(1))[:, None]
            ball = d - reach <= radii[None, :] + _SLACK * scale
            plane = d * d - (near * near)[:, None] <= 2.0 * reach * apart[home] + _SLACK * scale * scale
            yield pd.Series([np.nonzero(row)[0].astype(np.int32) for row in ball & plane])

    return cells(vector)
