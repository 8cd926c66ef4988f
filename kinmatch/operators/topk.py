"""The first rows of every key, whatever their number and however many rows share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Up to so many rows per key Spark itself cuts a ranked window before the shuffle; beyond, a key is ranked in parts first.
WINDOW_LIMIT = 1000
PART_ROWS = 65536


def top_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: int, name: str, spread: str, most: int) -> DataFrame:
    """The `keep` first rows of every key by `order`, with their place in column `name`.

    For a large `keep` the rows of a key are dealt by the hash of `spread` to parts, for about PART_ROWS of `most` rows each, and each
    part is cut to `keep` rows before they meet: no task sees all rows of a hot key. Rows may come in any number of parts."""

    def ranked(df: DataFrame, by: Sequence[str]) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return df.withColumn(name, place).where(F.col(name) <= keep)

    parts = -(-most // max(PART_ROWS, keep))
    if keep > WINDOW_LIMIT and parts > 1:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
        rows = ranked(rows, [*keys, "_part"]).drop("_part", name)
    return ranked(rows, keys)
