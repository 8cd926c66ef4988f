"""Embedding near-deduplication by a pivot-permutation index.

A vector is described by its DEPTH nearest reference points (pivots), nearest first; near vectors see nearly the same order
(Chavez, Figueroa and Navarro's scheme). Vectors are posted in the inverted lists of their pivots, pairs of a list that
share at least SHARED pivots are candidates, and candidates are verified by cosine in double precision.

1. Rows of equal vectors form a class; only classes take part below, with their number of rows.
2. Pivots: means of near vectors in a sample of at most max(SAMPLE, 4 * pivots) classes, those of the smallest hashes, at most
   MAX_PIVOTS, of which no two have a cosine above APART. Their number grows with the square root of the number of classes.
   Every class is described and posted; only the choice of the pivots rests on the sample.
3. Balls: classes within half the linking angle of their nearest pivot are linked to each other for certain, so they are
   counted, not compared. A large group of near copies has a member in the sample and becomes a ball. A member of a ball can
   be linked only to what lies within 1.5 linking angles of the pivot, so the ball meets only these, in its pivot's list.
4. Lists are cut into blocks of at most BLOCK classes, and a task compares a pair of blocks. A pair that shares several
   lists is judged in the first of them. A task sends the number of links of each class and a spanning forest of the links,
   never the pairs.
5. Components follow from forests, every ball being one node.

The index is approximate where two linked vectors share fewer than SHARED pivots: recall against brute force is 0.99 and more
in the tests, for pairs at the threshold in 64 dimensions. No list, block or number of partners has a cap.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing, and neither do those whose
number of components is not the commonest (the smallest such number, if several are): n_links 0, their own component.
Repeated rows are vectors of their own and linked to each other, also under one id, and each gets a row. A null id is never
a component's smallest; where a component has only null ids, component_id is null, and kept is false for null ids. Empty
tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators.grouping import group_items
from kinmatch.session import scratch_folder

LEAST = 0.95
DEPTH, SHARED = 8, 2
SAMPLE, MIN_PIVOTS, MAX_PIVOTS = 4096, 64, 4096
APART = 0.9
BLOCK = 2048
TILE = 256
#: Angles are known to about 1e-8; a ball's members are nearer to the pivot than half the linking angle by this much.
SLACK = 1e-6

FAR, NEAR, MEMBER = 0, 1, 2


def unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """A matrix of vectors of length 1 in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, wanted: int, least: float) -> np.ndarray:
    """Means of the vectors near to those of the sample that lie apart, taken in the given order."""
    chosen: list[np.ndarray] = []
    for row in sample:
        if len(chosen) == wanted:
            break
        if chosen and (np.stack(chosen) @ row).max() > APART:
            continue
        mean = sample[sample @ row >= least].sum(axis=0)
        mean /= np.linalg.norm(mean)
        if not chosen or (np.stack(chosen) @ mean).max() <= APART:
            chosen.append(mean)
    return np.stack(chosen)


def _describe(pivots: np.ndarray, least: float):
    """cls, v, size, min_id of a class with its ball (a pivot or -1), pivots in order, and roles in their lists (null: not posted)."""
    angle, depth = float(np.arccos(least)), min(DEPTH, len(pivots))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            near = unit_rows(batch.column("v"), pivots.shape[1]) @ pivots.T
            top = np.sort(np.argpartition(-near, depth - 1, axis=1)[:, :depth], axis=1)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
            angles = np.arccos(np.clip(np.take_along_axis(near, top, axis=1), -1, 1))
            inside = angles[:, 0] <= angle / 2 - SLACK
            role = np.where(angles <= 1.5 * angle + SLACK, NEAR, FAR)
            posted = ~inside[:, None] | (role == NEAR)
            role[inside, 0] = MEMBER
            offsets = pa.array(np.arange(0, top.size + 1, depth, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1).astype(np.int32), mask=m)) for x, m in ((top, None), (role, ~posted.reshape(-1)))]
            ball = pa.array(np.where(inside, top[:, 0], -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "v", "size", "min_id")), ball, *lists], ["cls", "v", "size", "min_id", "ball", "top", "roles"])

    return describe


def _hot(lists: np.ndarray, width: int) -> np.ndarray:
    """A row of 0 and 1 for each list of pivots; entries of -1 are left out."""
    out = np.zeros((len(lists), width + 1), np.float32)
    out[np.arange(len(lists))[:, None], lists] = 1
    return out[:, :width]


class _Forest:
    """Members of a cell, joined link by link; only links between parts that were apart are kept."""

    def __init__(self, n: int) -> None:
        self.part, self.kept = np.arange(n), []

    def add(self, i: int, others: np.ndarray) -> None:
        parts, first = np.unique(self.part[others], return_index=True)
        new = parts != self.part[i]
        for part, at in zip(parts[new].tolist(), first[new].tolist(), strict=True):
            self.kept.append((i, int(others[at])))
            self.part[self.part == part] = self.part[i]


def _compare(dimension: int, least: float):
    """Links of the classes of each cell: (cls, links, null) and, for a spanning forest, (cls, null, other).

    Rows come sorted by cell, whose size is bounded. In a cell of one block all meet; else side 0 meets side 1.
    """

    def cell(rows: pa.Table) -> pa.RecordBatch:
        n, pivot = rows.num_rows, rows.column("pivot")[0].as_py()
        x = unit_rows(rows.column("v").combine_chunks(), dimension)
        cls, size, ball, side = (rows.column(c).to_numpy() for c in ("cls", "size", "ball", "side"))
        tops = rows.column("top").combine_chunks().flatten().to_numpy().reshape(n, -1)
        roles = rows.column("roles").combine_chunks().flatten()
        posted = np.where(roles.is_valid().to_numpy(zero_copy_only=False).reshape(n, -1), tops, -1)
        known, local = np.unique(tops, return_inverse=True)
        shares = _hot(local.reshape(n, -1), len(known))
        # a pair is judged in the lowest of the lists in which both are posted
        earlier = _hot(np.where((posted >= 0) & (posted < pivot), local.reshape(n, -1), -1), len(known))
        both = side.min() != side.max()
        one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(n), np.arange(n))
        links, forest = np.zeros(n, np.int64), _Forest(n)
        for a in range(0, len(one), TILE):
            i = one[a : a + TILE]
            wanted = (shares[i] @ shares[two].T >= min(SHARED, tops.shape[1])) & (earlier[i] @ earlier[two].T == 0)
            wanted &= ~((ball[i] >= 0)[:, None] & (ball[i][:, None] == ball[two][None, :]))
            if not both:
                wanted &= i[:, None] < two[None, :]
            p, q = np.nonzero(wanted)
            if not len(p):
                continue
            p, q = i[p], two[q]
            cosine = np.concatenate([np.einsum("ij,ij->i", x[p[k : k + 32768]], x[q[k : k + 32768]]) for k in range(0, len(p), 32768)])
            p, q = p[cosine >= least], q[cosine >= least]
            np.add.at(links, p, size[q])
            np.add.at(links, q, size[p])
            cuts = np.flatnonzero(np.diff(p, prepend=-1, append=n))
            for k, m in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                forest.add(int(p[k]), q[k:m])
        told = np.flatnonzero(links)
        ends = np.array(forest.kept, np.int64).reshape(-1, 2)
        none = pa.nulls(len(told), pa.int64()), pa.nulls(len(ends), pa.int64())
        columns = [pa.concat_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())]) for u, w in ((cls[told], cls[ends[:, 0]]), (links[told], none[1]), (none[0], cls[ends[:, 1]]))]
        return pa.RecordBatch.from_arrays(columns, ["cls", "links", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            names = np.stack([rows.column(c).to_numpy() for c in ("pivot", "kind", "low", "high")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield cell(rows.slice(a, b - a))
            rest = rows.slice(cuts[-1])
        if rest is not None:
            yield cell(rest)

    return compare


def _cells(described: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Each posted class in the cells (pivot, kind, low, high) in which its block meets others, with its side."""
    posted = described.select("*", F.explode(F.arrays_zip(F.col("top").alias("pivot"), F.col("roles").alias("role"))).alias("post"))
    posted = posted.where("post.role IS NOT NULL").select("cls", "v", "size", "ball", "top", "roles", "post.pivot", "post.role")
    # One row for each pivot: at most MAX_PIVOTS.
    rows = posted.join(F.broadcast(sizes), "pivot").withColumn("hash", F.xxhash64("cls"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    at = lambda n: F.pmod("hash", blocks(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    kept = ["cls", "v", "size", "ball", "top", "roles", "pivot"]
    # Kind 0: classes outside the pivot's ball meet each other. Kind 1: the near ones of them meet the ball.
    outside = rows.where(f"role <> {MEMBER} AND n_outside > 1").withColumn("own", at("n_outside")).withColumn("met", others("n_outside"))
    outside = outside.select(*kept, F.lit(0).alias("kind"), F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), (F.col("own") > F.col("met")).cast("int").alias("side"))
    both = rows.where("n_near > 0 AND n_members > 0")
    near = both.where(f"role = {NEAR}").select(*kept, F.lit(1).alias("kind"), at("n_near").alias("low"), others("n_members").alias("high"), F.lit(0).alias("side"))
    member = both.where(f"role = {MEMBER}").select(*kept, F.lit(1).alias("kind"), others("n_near").alias("low"), at("n_members").alias("high"), F.lit(1).alias("side"))
    cells = outside.unionByName(near).unionByName(member)
    return cells.repartition("pivot", "kind", "low", "high").sortWithinPartitions("pivot", "kind", "low", "high", "cls")


def embedding_duplicates(
    table: DataFrame, least: float = LEAST, vec_id: str = "vec_id", vector: str = "embedding", pivots: int | None = None, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links join vectors with a cosine of at least `least`.

    `pivots` sets the number of pivots, else four square roots of the number of classes, MIN_PIVOTS to MAX_PIVOTS."""
    spark, folder = table.sparkSession, scratch_folder(table.sparkSession, "embedding-duplicates")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = table.select(table[vec_id].alias("vec_id"), table[vector].alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "rows")
    common = rows.where("usable").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    alone = F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), *alone)
    taking_part = F.col("usable") & (F.size("v") == common["d"])
    classes = rows.where(taking_part).groupBy("v").agg(F.count("*").alias("size"), F.min("vec_id").alias("min_id"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    n = classes.count()
    wanted = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, int(4 * n**0.5)))
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE, 4 * wanted)).toArrow()
    points = choose_pivots(unit_rows(sample.column("v").combine_chunks(), common["d"]), wanted, least)
    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("v", "min_id")}
    shape = f"cls bigint, v {kinds['v']}, size bigint, min_id {kinds['min_id']}, ball int, top array<int>, roles array<int>"
    described = stored(classes.mapInArrow(_describe(points, least), shape), "described")

    posts = described.select(F.explode(F.arrays_zip(F.col("top").alias("pivot"), F.col("roles").alias("role"))).alias("p")).where("p.role IS NOT NULL")
    counts = [F.count_if(F.col("p.role") != MEMBER).alias("n_outside"), F.count_if(F.col("p.role") == NEAR).alias("n_near"), F.count_if(F.col("p.role") == MEMBER).alias("n_members")]
    sizes = stored(posts.groupBy("p.pivot").agg(*counts), "sizes")
    found = stored(_cells(described, sizes, block).mapInArrow(_compare(common["d"], least), "cls bigint, links bigint, other bigint"), "links")

    # Nodes: a ball (negative) or a class outside the balls. Balls: at most MAX_PIVOTS rows.
    node = F.when(F.col("ball") >= 0, -1 - F.col("ball").cast("bigint")).otherwise(F.col("cls"))
    nodes = described.select("cls", node.alias("node"), "ball", "size", "min_id")
    balls = stored(nodes.where("ball >= 0").groupBy("ball").agg(F.sum("size").alias("in_ball")), "balls")
    ends = found.where("other IS NOT NULL").select("cls", "other")
    ends = ends.join(nodes.select("cls", F.col("node").alias("a")), "cls").join(nodes.select(F.col("cls").alias("other"), F.col("node").alias("b")), "other")
    grouped = stored(group_items(ends.select("a", "b").distinct(), "a", "b"), "groups")
    least_of = nodes.groupBy("node").agg(F.min("min_id").alias("least")).join(grouped.withColumnRenamed("item_id", "node"), "node", "left")
    least_of = stored(least_of.withColumn("group_id", F.coalesce("group_id", "node")), "least")
    heads = stored(least_of.groupBy("group_id").agg(F.min("least").alias("component_id")), "heads")
    named = stored(least_of.join(heads, "group_id").select("node", "component_id"), "components")

    sums = found.where("links IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    members = nodes.join(F.broadcast(balls), "ball", "left").join(sums, "cls", "left")
    total = F.coalesce(F.col("in_ball"), F.col("size")) - 1 + F.coalesce(F.col("links"), F.lit(0))
    in_ball = F.col("ball") >= 0
    members = members.select("cls", "node", in_ball.alias("in_ball"), total.alias("n_links"))
    # A ball may hold a third of all classes: its component is looked up in a table of at most MAX_PIVOTS rows.
    known = members.where("in_ball").join(F.broadcast(named.where("node < 0")), "node")
    known = known.unionByName(members.where("NOT in_ball").join(named.where("node >= 0"), "node"))
    told = stored(known.join(classes.select("cls", "v"), "cls").select("v", "n_links", "component_id"), "told")
    out = rows.where(taking_part).join(told, "v").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    rest = rows.where(~F.coalesce(taking_part, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), *alone)
    return out.unionByName(rest)
