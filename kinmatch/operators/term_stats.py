"""How rare a value is: document frequencies and the score of an exact hit."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(items: DataFrame, field: str) -> DataFrame:
    """(value, n) of one field; blanks are not values."""
    value = F.col(field).cast("string")
    return items.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def idf(n: Column, total: int | Column) -> Column:
    """BM25 inverse document frequency: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.log(1 + (total - n + 0.5) / (n + 0.5))


def idf_value(n: int, total: int) -> float:
    return math.log(1 + (total - n + 0.5) / (n + 0.5))


def term_stats(items: DataFrame, fields: list[str], total: int | None = None) -> DataFrame:
    """(field, value, n, idf) of all given fields."""
    total = items.count() if total is None else total
    parts = [value_counts(items, f).select(F.lit(f).alias("field"), "value", "n") for f in fields]
    return reduce(DataFrame.unionByName, parts).withColumn("idf", idf(F.col("n"), total))


def stored_counts(counts: DataFrame, slots: Mapping[str, str]) -> DataFrame:
    """(slot, value, n) from maintained counts (field, value, n); `slots` maps slots to fields."""
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("slot")) for s, f in slots.items()])
    wanted = counts.sparkSession.range(1).select(F.inline(names))
    return counts.where("value <> ''").join(F.broadcast(wanted), "field").select("slot", "value", "n")


def stored_total(counts: DataFrame) -> int:
    """The number of items, which maintained counts keep under the field ''."""
    return counts.where("field = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stored_stats(counts: DataFrame, fields: list[str]) -> DataFrame:
    """`term_stats` from maintained counts."""
    rows = counts.where(F.col("field").isin(fields)).select("field", "value", "n")
    return rows.withColumn("idf", idf(F.col("n"), stored_total(counts)))


def slot_counts(items: DataFrame, slots: list[str]) -> DataFrame:
    """(slot, value, n) of prepared text columns, from one scan: counts are combined before the shuffle."""
    values = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in slots])
    rows = items.select(F.explode(values).alias("v")).where("v.value <> ''")
    return rows.groupBy("v.slot", "v.value").agg(F.count("*").alias("n"))


def add_counts(q: DataFrame, counts: DataFrame, slots: list[str], broadcast_bytes: int) -> DataFrame:
    """Add n_<slot>, the number of items that carry the query's value, for every slot.

    `counts` is read twice, so it should be persisted. A field whose counts are measured to fit in
    `broadcast_bytes` is looked up by broadcast, without moving the queries. The others are joined on
    narrow rows (no vectors) and brought back in one join by query id; blank values get many different
    filler keys there, so that they do not meet in one partition."""
    sizes = counts.groupBy("slot").agg(F.sum(F.octet_length("value") + 24).alias("bytes")).collect()
    small = {r.slot for r in sizes if r.bytes <= broadcast_bytes}
    absent = set(slots) - {r.slot for r in sizes}
    wide = q.withColumns({f"n_{s}": F.lit(0).cast("bigint") for s in absent})

    def one(s: str) -> DataFrame:
        return counts.where(F.col("slot") == s).select(F.col("value").alias("_value"), F.col("n").alias(f"n_{s}"))

    large = [s for s in slots if s not in small and s not in absent]
    if large:
        narrow = q.select("query_id", *large)
        for s in large:
            filler = F.concat(F.lit("\0"), F.pmod(F.xxhash64("query_id"), F.lit(4096)).cast("string"))
            key = F.when(F.col(s) == "", filler).otherwise(F.col(s))
            narrow = narrow.withColumn("_key", key).join(one(s), F.col("_key") == F.col("_value"), "left").drop("_key", "_value")
        wide = wide.join(narrow.drop(*large), "query_id")
    for s in small.intersection(slots):
        wide = wide.join(F.broadcast(one(s)), F.col(s) == F.col("_value"), "left").drop("_value")
    return wide
