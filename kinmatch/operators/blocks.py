"""Splitting a join into blocks of bounded size, and running the scorer on each block pair.

Rows meet on a key (a value that must be equal, a metric cell, both, or nothing). A task holds the items of a block, at most
about `held_rows`, and the queries stream past them. Rows are repeated only for balance: a key with more than its share of
all pairs is cut into a grid of parts by row hash, so that a row is copied about as often as the root of the parts wanted
(`spread`), however many rows there are; more item parts are made only where one would be too large to hold. The split
table has at most about `spread` keys, so it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators.cells import choose_pivots, nearest_cell, visited_cells
from kinmatch.operators.lsh import Lsh
from kinmatch.operators.near_block import NearBlock, suits
from kinmatch.operators.scoring import ItemBlock, Scoring, result_schema, score_block


_LEAST = 64  # rows that are not cut further for balance alone
MOST_VISITS = 16  # cells that a query may visit in the mean: so often its row is copied
_ASKED = 1 << 15  # queries of a block that are looked at together
_WHOLE = 4096 * 4096  # pairs up to which keys are not looked at for balance


def partitions_for(spark: SparkSession, rows: int, rows_each: int = 2048) -> int:
    """Shuffle partitions for work that grows inside the tasks, where sizing by shuffled bytes gives too few:
    one per `rows_each` rows, from the cores in use up to the session's shuffle partitions."""
    cores = spark.sparkContext.defaultParallelism
    return min(max(cores, rows // rows_each), max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _part(id_col: str, parts) -> Column:
    return F.pmod(F.xxhash64(id_col), parts.cast("bigint")).cast("int")


def _each_part(parts) -> Column:
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def add_cells(
    q: DataFrame, items: DataFrame, vector: str, min_score: float, count: int
) -> tuple[DataFrame, DataFrame]:
    """Give both sides a `_cell` column; query rows repeat once per cell they have to visit."""
    visits, placed, _ = _cells(items, vector, min_score, count)
    return q.withColumn("_cell", F.explode(visits)), placed


def useful_cells(q: DataFrame, items: DataFrame, vector: str, min_score: float, count: int) -> tuple[DataFrame, DataFrame] | None:
    """As `add_cells`, if a few queries visit at most half of the cells and `MOST_VISITS` of them in the mean; None where
    cells would copy rows without skipping pairs, and held items cost less."""
    visits, placed, used = _cells(items, vector, min_score, count)
    few = q.select(vector).where(F.col(vector).isNotNull()).limit(256)
    mean = few.agg(F.avg(F.size(visits))).first()[0] or 0
    if mean > min(used / 2, MOST_VISITS):
        return None
    return q.withColumn("_cell", F.explode(visits)), placed


def _cells(items: DataFrame, vector: str, min_score: float, count: int) -> tuple[Column, DataFrame, int]:
    """The cells that a query vector has to visit, the items with `_cell`, and the number of cells with items."""
    pivots = choose_pivots(items, vector, count)
    placed = items.withColumn("_place", nearest_cell(F.col(vector), pivots))
    radii = np.full(len(pivots), -np.inf)
    for cell, radius in placed.groupBy("_place.cell").agg(F.max("_place.distance")).collect():
        radii[cell] = radius
    reach = math.sqrt(1.0 / min_score - 1.0) if min_score < 1.0 else 0.0
    visits = visited_cells(F.col(vector), pivots, radii, reach)
    return visits, placed.withColumn("_cell", F.col("_place.cell")).drop("_place"), int(np.isfinite(radii).sum())


def _grid(nq: int | Column, ni: int | Column, wanted, held_rows: int) -> tuple[Column, Column]:
    """Numbers of query and item parts for `wanted` block pairs: few copies of rows, item parts that can be held, and no
    parts for less than _LEAST rows."""
    nq, ni = (F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)).cast("double") for n in (nq, ni))
    parts = F.least(F.ceil(F.sqrt(wanted * ni / nq)), F.ceil(ni / _LEAST))
    parts = F.greatest(parts, F.ceil(ni / held_rows))
    return F.least(F.ceil(wanted / parts), F.ceil(nq / _LEAST)).cast("int"), parts.cast("int")


def _heavy_keys(q: DataFrame, items: DataFrame, keys: list[str], nq: int, ni: int, held_rows: int, spread: int) -> DataFrame:
    """(keys, _nq, _ni): the parts of the keys that have more than a share of all pairs, or more items than can be held. By
    Cauchy-Schwarz these are at most about the root of `spread`, and ni / held_rows."""
    share = max(nq * ni / max(spread, 1), float(_LEAST * _LEAST))
    counts = q.groupBy(*keys).agg(F.count("*").alias("_a")).join(items.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    pairs = F.col("_a").cast("double") * F.col("_b")
    parts = _grid(F.col("_a"), F.col("_b"), F.ceil(pairs / share), held_rows)
    return counts.where((pairs > share) | (F.col("_b") > held_rows)).select(*keys, parts[0].alias("_nq"), parts[1].alias("_ni"))


def held_blocks(
    q: DataFrame, items: DataFrame, keys: list[str], nq: int, ni: int, held_rows: int, spread: int
) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Both sides with their block columns, the full block key, and the number of partitions to use. Without keys that key is
    one number from 0 on, the partition. `spread` is the number of block pairs wanted for all pairs."""
    if not keys:
        pq, pi = q.sparkSession.range(1).select(*_grid(nq, ni, F.lit(float(max(spread, 1))), held_rows)).first()
        q = q.withColumn("_pq", _part("query_id", F.lit(pq))).withColumn("_pi", _each_part(F.lit(pi)))
        items = items.withColumn("_pi", _part("item_id", F.lit(pi))).withColumn("_pq", _each_part(F.lit(pq)))
        q, items = (df.withColumn("_block", F.col("_pq") * F.lit(pi) + F.col("_pi")).drop("_pq", "_pi") for df in (q, items))
        return q, items, ["_block"], pq * pi
    if nq * ni > _WHOLE or ni > held_rows:
        heavy = F.broadcast(_heavy_keys(q, items, keys, nq, ni, held_rows, spread))
        q, items = q.join(heavy, keys, "left"), items.join(heavy, keys, "left")
    else:
        q, items = (df.withColumns({"_nq": F.lit(1), "_ni": F.lit(1)}) for df in (q, items))
    nq_parts, ni_parts = (F.coalesce(F.col(n), F.lit(1)) for n in ("_nq", "_ni"))
    q = q.withColumn("_pq", _part("query_id", nq_parts)).withColumn("_pi", _each_part(ni_parts))
    items = items.withColumn("_pi", _part("item_id", ni_parts)).withColumn("_pq", _each_part(nq_parts))
    return q.drop("_nq", "_ni"), items.drop("_nq", "_ni"), [*keys, "_pq", "_pi"], partitions_for(q.sparkSession, nq + ni)


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch cut where one of the columns changes."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in columns:
        column = batch.column(name)
        change |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def block_join(
    q: DataFrame, items: DataFrame, keys: list[str], scoring: Scoring, gen: int | None, lsh: Lsh | None = None, **sizes
) -> DataFrame:
    """Score all pairs that meet on `keys`; see `ItemBlock.score` for the result. With `lsh` the keys hold its buckets. Both
    sides of a block arrive in one task, its items first."""
    return block_scores(q, items, keys, gen, lsh, **sizes)(scoring, True)


def block_scores(
    q: DataFrame, items: DataFrame, keys: list[str], gen: int | None, lsh: Lsh | None = None, **sizes
) -> Callable[[Scoring, bool], DataFrame]:
    """`block_join` for a scoring rule, with the totals of the queries or, where these are not wanted, possibly without."""
    q, items, block, partitions = held_blocks(q, items, keys, **sizes)
    schema = result_schema(q.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    both = items.withColumn("_side", F.lit(0)).unionByName(q.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(partitions, F.col("_block")) if block == ["_block"] else both.repartition(partitions, *block)
    both = both.sortWithinPartitions(*block, "_side")

    def scores(scoring: Scoring, counted: bool) -> DataFrame:
        def held_items(key: tuple, rows: list[pa.RecordBatch]) -> ItemBlock:
            if lsh is None and suits(scoring, gen):
                return NearBlock(pa.Table.from_batches(rows), scoring, gen, counted)
            once = lsh.judged_here(key[block.index("_table")], scoring.clauses[gen].min_score) if lsh is not None else None
            return ItemBlock(pa.Table.from_batches(rows), scoring, gen, once)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, rows, held, asked, waits = None, [], None, [], 0
            for batch in batches:
                for run in _runs(batch, [*block, "_side"]):
                    key = tuple(run.column(k)[0].as_py() for k in block)
                    if key != here or waits >= _ASKED:
                        if asked:
                            for found in held.score(pa.Table.from_batches(asked)):
                                yield from found.to_batches()
                        asked, waits = [], 0
                    if key != here:
                        here, rows, held = key, [], None
                    if run.column("_side")[0].as_py() == 0:
                        rows.append(run)
                        continue
                    if held is None and rows:
                        held, rows = held_items(key, rows), []
                    if held is not None:
                        asked.append(run)
                        waits += run.num_rows
            if asked:
                for found in held.score(pa.Table.from_batches(asked)):
                    yield from found.to_batches()

        return both.mapInArrow(score, schema)

    return scores


def scan_join(few: pa.Table, items: DataFrame, scoring: Scoring, query_type: str) -> DataFrame:
    """Score a few queries, held in the task closure, against every item in one pass without a shuffle."""
    schema = result_schema(query_type, items.schema["item_id"].dataType.simpleString())

    def score(batches):
        for batch in batches:
            yield from score_block(few, pa.Table.from_batches([batch]), scoring, None).to_batches()

    return items.mapInArrow(score, schema)
