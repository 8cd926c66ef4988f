"""Stored specifications as a table: one row per clause, over any number of indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCORED = (
    "struct<function_score: struct<"
    "query: struct<knn: map<string, struct<vector: string, min_score: string>>, term: map<string, string>>,"
    "weight: double>>"
)
QUERY_SCHEMA = (
    "size int, explain boolean, query struct<bool: struct<minimum_should_match: string, "
    f"must: array<{_SCORED}>, should: array<{_SCORED}>>>"
)


def parse_query(search_config: Column) -> Column:
    """The stored query text as a struct; null where it is not valid JSON."""
    return F.from_json(search_config, QUERY_SCHEMA)


def spec_fields(catalog: DataFrame) -> DataFrame:
    """(index_name, field, kind, placement, min_score, weight, size, explain, min_should), the editor's
    field table. Of several clauses of a field the last counts."""
    parsed = catalog.select("index_name", parse_query(F.col("search_config")).alias("q"))
    groups = F.array(
        *[
            F.struct(F.lit(occur).alias("placement"), F.col("q.query.bool")[occur].alias("clauses"))
            for occur in ("must", "should")
        ]
    )
    rows = parsed.select("index_name", "q", F.posexplode(groups).alias("g", "group"))
    rows = rows.select("index_name", "q", "g", "group.placement", F.posexplode("group.clauses").alias("pos", "c"))
    knn, term = F.col("c.function_score.query.knn"), F.col("c.function_score.query.term")
    column = F.when(F.size(knn) > 0, F.map_keys(knn)[0]).when(F.size(term) > 0, F.map_keys(term)[0])
    is_vector = F.size(knn) > 0
    clause = F.struct(
        F.col("g"),
        F.col("pos"),
        F.when(is_vector, F.lit("vector")).otherwise(F.lit("exact")).alias("kind"),
        F.col("placement"),
        F.when(is_vector, F.coalesce(F.map_values(knn)[0]["min_score"].try_cast("double"), F.lit(0.0))).alias("min_score"),
        F.coalesce("c.function_score.weight", F.lit(1.0)).alias("weight"),
    )
    least = F.regexp_extract(F.coalesce("q.query.bool.minimum_should_match", F.lit("")), r"^\s*([+-]?\d+)", 1)
    rows = rows.where(column.isNotNull()).select(
        "index_name",
        F.when(is_vector, F.regexp_replace(column, "Embedding$", "")).otherwise(column).alias("field"),
        clause.alias("clause"),
        F.coalesce(F.nullif(F.col("q.size"), F.lit(0)), F.lit(10)).alias("size"),
        F.coalesce("q.explain", F.lit(False)).alias("explain"),
        F.coalesce(F.nullif(least, F.lit("")).cast("int"), F.lit(0)).alias("min_should"),
    )
    last = rows.groupBy("index_name", "field", "size", "explain", "min_should").agg(F.max("clause").alias("c"))
    return last.select(
        "index_name", "field", "c.kind", "c.placement", "c.min_score", "c.weight", "size", "explain", "min_should"
    )
