"""Text to vector: a stored vector table, hashed character n-grams, or a caller's Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

# Fixed values of the hashed vector: one multiplier per position of the 3-gram, and the modulus.
GRAM_FACTORS = (7919, 104729, 611953)
GRAM_MODULUS = 1000003

Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashed_ngrams(text: Column, dim: int = 64) -> Column:
    """Unit-length vector of hashed character 3-grams of the lower-cased text, which is set between two
    blanks so that even one character gives a gram. Empty text gives null.

    Lexical similarity only. The whole text counts, whatever its length. Each Arrow batch is handled
    with numpy over the code points, so long texts cost no per-character expression calls."""

    @F.pandas_udf(VECTOR)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, b, c = GRAM_FACTORS

        def one(s: str | None):
            if not s:
                return None
            s = f" {s} "
            p = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            grams = (p[:-2] * a + p[1:-1] * b + p[2:] * c) % GRAM_MODULUS % dim
            counts = np.bincount(grams, minlength=dim).astype(np.float64)
            return (counts / np.sqrt(counts @ counts)).astype(np.float32)

        for s in batches:
            yield s.map(one)

    return vectors(F.lower(text))


def hashed_embedder(dim: int = 64) -> Embedder:
    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, hashed_ngrams(F.col(text), dim))

    return embed


def function_embedder(fn: Callable[[list[str]], list], batch_rows: int = 96) -> Embedder:
    """Call `fn(texts) -> vectors` on batches of texts, e.g. a hosted or local model. Blank texts are not
    sent; their vector is null."""

    @F.pandas_udf(VECTOR)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            todo = [i for i, t in enumerate(s) if t is not None and t != ""]
            for start in range(0, len(todo), batch_rows):
                part = todo[start : start + batch_rows]
                for i, vec in zip(part, fn([s.iloc[j] for j in part])):
                    out.iat[i] = np.asarray(vec, dtype=np.float32)
            yield out

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, vectors(F.col(text)))

    return embed


def table_embedder(vectors: DataFrame, key: str, vector: str, on: str | None = None) -> Embedder:
    """Take stored vectors from a table, joined on `key` = the text itself, or = column `on` of the items.
    `key` must be unique in the table."""

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        table = vectors.select(F.col(key).alias("_vector_key"), F.col(vector).cast(VECTOR).alias(out))
        left = df.withColumn("_join_key", F.col(on or text))
        return left.join(table, F.col("_join_key") == F.col("_vector_key"), "left").drop("_join_key", "_vector_key")

    return embed
