"""Radial similarity join: all pairs at or above a similarity, without forming the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.operators.blocks import block_join, useful_cells
from kinmatch.operators.lsh import Lsh, add_buckets
from kinmatch.operators.scoring import Scoring
from kinmatch.operators.search import MatchOptions
from kinmatch.plans.spec import Clause


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared Euclidean distance) of two vector columns."""
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return 1 / (1 + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def radial_join(
    queries: DataFrame,
    items: DataFrame,
    vector: str,
    min_score: float,
    query_id: str = "item_id",
    item_id: str = "item_id",
    options: MatchOptions | None = None,
) -> DataFrame:
    """(query_id, item_id, score) of every pair with similarity >= `min_score`. Exact."""
    opt = options or MatchOptions()
    scoring, q, side = _vector_sides(queries, items, vector, min_score, query_id, item_id, opt)
    nq, ni, keys = queries.count(), items.count(), []
    if min_score > 0 and ni // opt.cell_rows >= 2:
        placed = useful_cells(q, side, "v0", min_score, ni // opt.cell_rows)
        if placed:
            (q, side), keys = placed, ["_cell"]
    return _near_pairs(q, side, keys, scoring, nq, ni, opt)


def _vector_sides(queries, items, vector: str, min_score: float, query_id: str, item_id: str, opt: MatchOptions):
    """The scoring rule and both sides in the scorer's layout, with the vector as the one required clause."""
    scoring = Scoring((Clause("v", "vector", "must", 1.0, min_score),), 0, None, opt.exclude_self)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v0")).where("v0 is not null")
    q = q.selectExpr("*", "1L AS act", "1L AS gens", "0L AS heavy")
    return scoring, q, items.select(F.col(item_id).alias("item_id"), F.col(vector).alias("v0")).where("v0 is not null")


def _near_pairs(q, side, keys: list[str], scoring: Scoring, nq: int, ni: int, opt: MatchOptions, lsh: Lsh | None = None) -> DataFrame:
    spread = 4 * q.sparkSession.sparkContext.defaultParallelism
    pairs = block_join(q, side, keys, scoring, 0, lsh, nq=nq, ni=ni, held_rows=opt.held_rows, spread=spread)
    return pairs.where(F.col("item_id").isNotNull()).select("query_id", "item_id", "score")


def lsh_radial_join(
    queries: DataFrame,
    items: DataFrame,
    vector: str,
    min_score: float,
    query_id: str = "item_id",
    item_id: str = "item_id",
    lsh: Lsh | None = None,
    options: MatchOptions | None = None,
) -> DataFrame:
    """Approximate radial join: only rows that share a bucket in some hash table are compared. Every pair given is right and
    given once, some may be missing. Buckets of any size are split into blocks like other keys, and only near pairs leave
    a block."""
    opt, lsh = options or MatchOptions(), lsh or Lsh()
    scoring, q, side = _vector_sides(queries, items, vector, min_score, query_id, item_id, opt)
    q, side = add_buckets(q, side, "v0", min_score, lsh)
    nq, ni = queries.count() * lsh.tables, items.count() * lsh.tables
    return _near_pairs(q, side, ["_table", "_bucket"], scoring, nq, ni, opt, lsh)


def lsh_comparisons(queries: DataFrame, items: DataFrame, vector: str, min_score: float, lsh: Lsh | None = None) -> DataFrame:
    """One row (compared): the row pairs that `lsh_radial_join` compares, once for each bucket in which they meet."""
    lsh = lsh or Lsh()
    q, side = (df.select(F.col(vector).alias("v")).where("v is not null") for df in (queries, items))
    q, side = (df.groupBy("_table", "_bucket").agg(F.count("*").alias(n)) for df, n in zip(add_buckets(q, side, "v", min_score, lsh), ("nq", "ni")))
    return q.join(side, ["_table", "_bucket"]).agg(F.coalesce(F.sum(F.col("nq") * F.col("ni")), F.lit(0)).alias("compared"))
