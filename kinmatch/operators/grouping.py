"""Groups of related items: connected components over accepted matches.

Large-star / small-star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
every round reattaches neighbours to the smallest id they can see, and the number of rounds grows with the
logarithm of the longest path. Each round is grouped minima (combined before the shuffle) and two equi-joins
whose small side has one row per item; hub items with very many edges are split by adaptive skew joins.
Every round is written to the shared scratch folder, which cuts the lineage and survives lost executors.

Before the first round every task cuts its matches down to a spanning forest: a row for each item it has seen, however many
matches that item has. So matches, whose number can grow with the square of the items, are neither shuffled nor stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinmatch.session import scratch_folder


FOREST_ROWS = 1 << 20  # matches that a task holds at once


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The lowest node that each of n nodes is connected with by the edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        root[np.maximum(ra, rb)] = np.minimum(ra, rb)  # roots move to lower roots only, so there is no cycle
        while not np.array_equal(root, shorter := root[root]):
            root = shorter


def _forest(batch: pa.Table) -> pa.Table:
    """As few edges that connect the same nodes; a node without another one keeps an edge with itself."""
    ends = pc.dictionary_encode(pa.concat_arrays([*batch.column("a").chunks, *batch.column("b").chunks]))
    codes, n = ends.indices.to_numpy(), len(ends.dictionary)
    root = _roots(codes[: batch.num_rows], codes[batch.num_rows :], n)
    wanted = (root != np.arange(n)) | (np.bincount(root, minlength=n) == 1)
    nodes = np.flatnonzero(wanted)
    return pa.table({"a": ends.dictionary.take(pa.array(nodes)), "b": ends.dictionary.take(pa.array(root[nodes]))}, schema=batch.schema)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of a task as forests, of bounded memory."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= FOREST_ROWS:
            held = [_forest(pa.concat_tables(held))]
            if held[0].num_rows >= FOREST_ROWS // 2:
                yield from held.pop().to_batches()
    if held and sum(t.num_rows for t in held):
        yield from _forest(pa.concat_tables(held)).to_batches()


def connected(matches: DataFrame, left: str = "query_id", right: str = "item_id") -> DataFrame:
    """(a, b): matches that connect the same items, with a row at most for each item of a task."""
    kind = matches.select(F.coalesce(left, right).alias("a")).schema["a"].dataType
    ends = matches.select(F.col(left).cast(kind).alias("a"), F.col(right).cast(kind).alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(_forests, f"a {kind.simpleString()}, b {kind.simpleString()}")


def _downward(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    low = _lowest(edges)
    moved = edges.join(low, edges.b == low.node, "left").select("a", F.coalesce("low", "b").alias("b"))
    return _downward(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the node's smallest neighbour."""
    low = _lowest(edges)
    moved = edges.join(low, edges.a == low.node).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _downward(moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))))


def group_items(
    matches: DataFrame,
    left: str = "query_id",
    right: str = "item_id",
    items: DataFrame | None = None,
    item_id: str = "item_id",
    max_rounds: int = 50,
) -> DataFrame:
    """(item_id, group_id), the group being its smallest item id. Items of `items` without a match form
    groups of their own."""
    spark = matches.sparkSession
    folder = scratch_folder(spark, "groups")

    def stored(df: DataFrame, n: int) -> tuple[DataFrame, tuple]:
        path, seen = f"{folder}/round-{n}", Observation()
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        df.distinct().observe(seen, F.count("*").alias("n"), digest.alias("digest")).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["digest"])

    start = connected(matches, left, right)
    start.write.parquet(f"{folder}/matches")
    start = spark.read.schema(start.schema).parquet(f"{folder}/matches")
    edges, state = stored(_downward(start), 0)
    for n in range(1, max_rounds + 1):
        edges, new_state = stored(_small_star(_large_star(edges)), n)
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"groups did not settle within {max_rounds} rounds")

    grouped = edges.select(F.col("a").alias("item_id"), F.col("b").alias("group_id"))
    heads = edges.select(F.col("b").alias("item_id"), F.col("b").alias("group_id")).distinct()
    out = grouped.unionByName(heads)
    if items is not None:
        rest = items.select(F.col(item_id).alias("item_id")).join(out.select("item_id"), "item_id", "left_anti")
        out = out.unionByName(rest.select("item_id", F.col("item_id").alias("group_id")))
    else:
        own = start.select(F.col("a").alias("item_id")).where(F.col("a") == F.col("b")).distinct()
        own = own.join(out.select("item_id"), "item_id", "left_anti")
        out = out.unionByName(own.select("item_id", F.col("item_id").alias("group_id")))
    return out


def extend_groups(groups: DataFrame, matches: DataFrame, left: str = "query_id", right: str = "item_id", items: DataFrame | None = None, item_id: str = "item_id", max_rounds: int = 50) -> DataFrame:
    """(item_id, group_id) after more matches: `groups` as `group_items` gave them, every known group being one node now.

    The rounds work on the new matches alone, mapped to groups, and only items of groups that change are given another
    group. A group's id is its smallest item id, so the result is that of grouping all matches at once."""
    spark, folder = groups.sparkSession, scratch_folder(groups.sparkSession, "more-groups")
    one, two = (groups.select(F.col("item_id").alias(f"_{s}"), F.col("group_id").alias(f"_group_{s}")) for s in "ab")
    edges = connected(matches, left, right)
    edges = edges.join(one, edges.a == one._a, "left").join(two, edges.b == two._b, "left")
    edges = edges.select(F.coalesce("_group_a", "a").alias("a"), F.coalesce("_group_b", "b").alias("b")).distinct()
    moved = group_items(edges, "a", "b", max_rounds=max_rounds).select(F.col("item_id").alias("node"), F.col("group_id").alias("to"))
    # Stored, so that both sides of the joins are shuffled and a group with very many items can be split.
    moved.write.parquet(folder)
    moved = spark.read.schema(moved.schema).parquet(folder)
    kept = groups.join(moved.where("node <> to"), groups.group_id == moved.node, "left")
    kept = kept.select("item_id", F.coalesce("to", "group_id").alias("group_id"))
    known = groups.select(F.col("group_id").alias("node")).distinct()
    out = kept.unionByName(moved.join(known, "node", "left_anti").select(F.col("node").alias("item_id"), F.col("to").alias("group_id")))
    if items is not None:
        rest = items.select(F.col(item_id).alias("item_id")).join(out.select("item_id"), "item_id", "left_anti")
        out = out.unionByName(rest.select("item_id", F.col("item_id").alias("group_id")))
    return out
