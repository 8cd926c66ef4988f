"""The index catalog: one row per index with its field roles and stored search specification."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinmatch.plans.spec import EXACT, IGNORE, VECTOR, SearchSpec
from kinmatch.sources.versions import VersionedTable

CATALOG_SCHEMA = (
    "index_name string, file_name string, vector_fields array<string>, exact_fields array<string>, "
    "search_config string, user_id string, created_at timestamp, updated_at timestamp"
)


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def index_number(name: Column) -> Column:
    """The number in item<NNN>...; null for other names. All digits are read, not only three."""
    digits = F.regexp_extract(name, r"^item(\d{3,}|\d{1,2}$)", 1)
    return F.nullif(digits, F.lit("")).cast("bigint")


def next_index_name(names: DataFrame, user_id: str | Column, column: str = "index_name") -> DataFrame:
    """One row: item<highest number + 1>-<user>, over the names of all users."""
    user = F.lit(user_id) if isinstance(user_id, str) else user_id
    top = names.agg(F.coalesce(F.max(index_number(F.col(column))), F.lit(0)).alias("top"))
    return top.select(F.concat(F.format_string("item%03d-", F.col("top") + 1), user).alias("index_name"))


@dataclass
class Created:
    catalog: DataFrame  # the catalog with the new row, if there is one
    rows: DataFrame  # the new row; empty if the name exists
    status: DataFrame  # (index_name, created, message)


def create_index(
    catalog: DataFrame,
    roles: Mapping[str, str],
    user_id: str,
    file_name: str = "",
    index_name: str | None = None,
    now: dt.datetime | None = None,
) -> Created:
    """Add an index with its default specification, unless the name exists already."""
    if all(r == IGNORE for r in roles.values()):
        raise ValueError("at least one column must be VECTOR or EXACT")
    named = (
        catalog.sparkSession.range(1).select(F.lit(index_name).alias("index_name"))
        if index_name
        else next_index_name(catalog, user_id)
    )

    def listed(role: str) -> Column:
        return F.array(*[F.lit(h) for h, r in roles.items() if r == role]).cast("array<string>")

    stamp = F.lit(now) if now else F.current_timestamp()
    made = named.select(
        "index_name",
        F.lit(file_name).alias("file_name"),
        listed(VECTOR).alias("vector_fields"),
        listed(EXACT).alias("exact_fields"),
        F.lit(SearchSpec.from_roles(roles).to_json(named=True)).alias("search_config"),
        F.lit(user_id).alias("user_id"),
        stamp.cast("timestamp").alias("created_at"),
        stamp.cast("timestamp").alias("updated_at"),
    )
    known = catalog.select(F.col("index_name").alias("known")).distinct()
    rows = made.join(known, F.col("index_name") == F.col("known"), "left_anti")
    flagged = named.join(known, F.col("index_name") == F.col("known"), "left")
    created = F.col("known").isNull()
    text = F.when(created, F.lit("created successfully")).otherwise(F.lit("already exists"))
    status = flagged.select("index_name", created.alias("created"), F.concat_ws(" ", F.lit("Index"), "index_name", text).alias("message"))
    return Created(catalog.unionByName(rows, allowMissingColumns=True), rows, status)


def index_config(catalog: DataFrame, index_name: str) -> DataFrame:
    """The row of one index, or none."""
    return catalog.where(F.col("index_name") == index_name)


def list_indexes(catalog: DataFrame, user_id: str) -> DataFrame:
    """Names of a user's indexes."""
    return catalog.select("index_name").where(F.col("index_name").endswith("-" + user_id)).orderBy("index_name")


def indexes_by_creation(catalog: DataFrame, user_id: str) -> DataFrame:
    return catalog.where(F.col("user_id") == user_id).orderBy("created_at", "index_name")


def load_spec(catalog: DataFrame, index_name: str) -> SearchSpec:
    row = index_config(catalog, index_name).select("search_config").first()
    if row is None or not row[0]:
        raise LookupError(f"search configuration not found for index {index_name}")
    return SearchSpec.from_json(row[0], strict=True)


def save_spec(catalog: DataFrame, index_name: str, spec: SearchSpec, now: dt.datetime | None = None) -> DataFrame:
    """The catalog with the specification of one index replaced."""
    chosen = F.col("index_name") == index_name
    stamp = F.lit(now) if now else F.current_timestamp()
    return catalog.withColumns(
        {
            "search_config": F.when(chosen, F.lit(spec.to_json())).otherwise(F.col("search_config")),
            "updated_at": F.when(chosen, stamp.cast("timestamp")).otherwise(F.col("updated_at")),
        }
    )


def load_roles(catalog: DataFrame, index_name: str) -> dict[str, str]:
    """VECTOR and EXACT columns of an index; empty when the index is unknown."""
    row = index_config(catalog, index_name).select("vector_fields", "exact_fields").first()
    if row is None:
        return {}
    return {**dict.fromkeys(row.vector_fields or [], VECTOR), **dict.fromkeys(row.exact_fields or [], EXACT)}


def role_tags(columns: DataFrame, vector_fields: Column, exact_fields: Column, column: str = "column_name") -> DataFrame:
    """Tag column names as vector, exact or unused. Names are compared without blanks, underscores and
    case, so that headers and their camelCase forms agree."""

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"[\s_]+", ""))

    name = plain(F.col(column))
    tag = (
        F.when(F.array_contains(F.transform(vector_fields, plain), name), F.lit("vector"))
        .when(F.array_contains(F.transform(exact_fields, plain), name), F.lit("exact"))
        .otherwise(F.lit("unused"))
    )
    return columns.select(column, tag.alias("role"))


class StoredCatalog:
    """The catalog as a versioned table: every change publishes a new version, with one row for each index."""

    def __init__(self, root: str) -> None:
        self.table = VersionedTable(root)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        found = self.table.read(spark, version)
        return empty_catalog(spark) if found is None else found

    def create(self, spark: SparkSession, roles: Mapping[str, str], user_id: str, file_name: str = "", index_name: str | None = None, now: dt.datetime | None = None) -> DataFrame:
        """Add an index, unless the name exists; returns (index_name, created, message). The number in a name that is not given is
        drawn again if another writer was faster."""
        status: list[Row] = []

        def edit(catalog: DataFrame | None) -> DataFrame | None:
            made = create_index(empty_catalog(spark) if catalog is None else catalog, roles, user_id, file_name, index_name, now)
            status[:] = made.status.collect()
            return made.catalog if status[0]["created"] else None

        self.table.change(spark, edit)
        return spark.createDataFrame(status, "index_name string, created boolean, message string")

    def save_spec(self, spark: SparkSession, index_name: str, spec: SearchSpec, now: dt.datetime | None = None) -> int:
        """Replace the specification of one index; unknown indexes raise a LookupError."""

        def edit(catalog: DataFrame | None) -> DataFrame:
            if catalog is None or index_config(catalog, index_name).isEmpty():
                raise LookupError(f"no index {index_name}")
            return save_spec(catalog, index_name, spec, now)

        return self.table.change(spark, edit)
