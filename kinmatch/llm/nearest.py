"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length 1 and rotated into at least MIN_BITS dimensions by a random orthogonal matrix; the
signs are the code. A code and two scalars, the length and the inner product of the vector with its own code, estimate any
inner product without bias, and bound the error (Gao and Long's scheme): the bound shrinks with the square root of the
number of bits, and EPSILON is its width in standard deviations.

A stated set of queries meets all rows in blocks: codes and queries are split into blocks of bounded size, and a task
compares one block of either. For a query it keeps the rows whose least possible distance does not exceed the k-th
smallest of the largest possible distances, in the block and then overall. Only these are reranked, with their original
vectors, in double precision.

Rows with one and the same vector are one point: only the k + 1 smallest ids of them can be among k neighbours, ties going
to smaller ids, so the others are represented by these.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those whose number
of components is not the commonest (the smallest such number, if several are). Null ids take no part. With fewer than k
candidates all are returned. Repeated rows: one id with the same vector is one row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.session import scratch_folder

MIN_BITS = 512
EPSILON = 1.9
ROWS, QUERIES = 16384, 2048
SEED = 20260


def rotation(dimension: int, bits: int, seed: int = SEED) -> np.ndarray:
    """`dimension` orthonormal rows of `bits` components."""
    normal = np.random.default_rng(seed).standard_normal((bits, dimension))
    return np.linalg.qr(normal)[0].T


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths after centring, and each unit vector's inner product with its own code."""
    moved = vectors - centre
    length = np.linalg.norm(moved, axis=1)
    unit = moved / np.where(length > 0, length, 1)[:, None]
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def bounds(codes: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances, by queries and rows. queries: centred and rotated."""
    signs = (np.unpackbits(codes, axis=1)[:, :bits].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    size = np.linalg.norm(queries, axis=1)
    safe = np.where(own > 0, own, 1)
    inner = (queries.astype(np.float32) @ signs.T) / safe[None, :]
    error = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / safe / np.sqrt(bits - 1)
    middle = length[None, :] ** 2 + size[:, None] ** 2
    scale, slack = 2 * length[None, :], size[:, None] * error[None, :]
    return middle - scale * (inner + slack), middle - scale * (inner - slack)


def _best(lows: np.ndarray, highs: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Which rows may be among the k nearest of each query; `same` marks the query's own row."""
    highs = np.where(same, np.inf, highs)
    limit = np.partition(highs, k - 1, axis=1)[:, k - 1] if highs.shape[1] > k else np.full(len(highs), np.inf)
    return (lows <= limit[:, None]) & ~same


def _compare(k: int, bits: int) -> Callable:
    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            ids = rows["vec_id"].to_numpy()
            length, own = rows["length"].to_numpy(), rows["own"].to_numpy()
            for i in range(0, len(asked), 256):
                some = asked.iloc[i : i + 256]
                names = some["query_id"].to_numpy()
                low, high = bounds(codes, length, own, np.stack(some["turned"].to_list()), bits)
                q, r = np.nonzero(_best(low, high, names[:, None] == ids[None, :], k))
                out.append(pd.DataFrame({"query_id": names[q], "vec_id": ids[r], "low": low[q, r].astype(float), "high": high[q, r].astype(float)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "low": [], "high": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return compare


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest found of every row where `is_query` (over vec_id) holds."""
    spark, folder = table.sparkSession, scratch_folder(table.sparkSession, "nearest")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    plain = table.select(table[vec_id].cast("bigint").alias("vec_id"), table[vector].alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where(finite & F.exists("v", lambda x: x != 0)).distinct()
    plain = stored(plain, "vectors")
    common = plain.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dimension = common["d"] if common else 1
    plain = plain.where(F.size("v") == dimension)

    # One point for equal vectors, k + 1 ids each: ranks are cut before the shuffle.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = plain.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    sums = [F.sum(F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dimension)]
    total = plain.agg(F.count("*").alias("n"), *sums).first()
    n = total["n"]
    centre = np.array([total[f"s{i}"] or 0.0 for i in range(dimension)]) / max(n, 1)
    bits = max(MIN_BITS, -(-dimension // 64) * 64)
    turn = rotation(dimension, bits)

    def code(batches):
        for pdf in batches:
            if len(pdf):
                codes, length, own = encode(np.stack(pdf["v"].to_list()).astype(float), centre, turn)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": [c.tobytes() for c in codes], "length": length, "own": own})

    def turned(batches):
        for pdf in batches:
            if len(pdf):
                q = (np.stack(pdf["v"].to_list()).astype(float) - centre) @ turn
                yield pd.DataFrame({"query_id": pdf["vec_id"], "turned": list(q)})

    codes = points.mapInPandas(code, "vec_id bigint, code binary, length double, own double")
    asked = plain.where(is_query)
    blocks = -(-n // ROWS)
    groups = max(1, -(-asked.count() // QUERIES))
    queries = asked.mapInPandas(turned, "query_id bigint, turned array<double>")
    # Every block of rows meets every group of queries: rows are repeated once for each group, queries for each block.
    left = codes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    pairs = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp"))
    found = stored(pairs.applyInPandas(_compare(k, bits), "query_id bigint, vec_id bigint, low double, high double"), "candidates")

    by_high = F.row_number().over(Window.partitionBy("query_id").orderBy("high"))
    limit = found.withColumn("nth", by_high).where(F.col("nth") <= k).groupBy("query_id").agg(F.max("high").alias("limit"), F.count("*").alias("m"))
    chosen = found.join(limit, "query_id").where((F.col("low") <= F.col("limit")) | (F.col("m") < k)).select("query_id", "vec_id")
    chosen = chosen.join(plain, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = chosen.select("query_id", "vec_id", distance(F.col("v"), F.col("q")).alias("score")).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
