"""Streaming ingest of files that arrive in a landing folder: assets/<identity>/<index>/<file>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmatch.functions.embed import Embedder
from kinmatch.functions.text import camel_case
from kinmatch.plans.spec import EXACT, VECTOR
from kinmatch.sources.files import (
    string_schema,
    with_position,
    csv_options,
    index_name_from_path,
    parse_workbooks,
    widen_workbooks,
    workbook_columns,
)
from kinmatch.sources.ingest import ingest
from kinmatch.sources.tables import Tables

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def landing_csv(spark: SparkSession, folder: str, columns: Sequence[str], files_per_trigger: int = 100) -> DataFrame:
    """Rows of CSV files as they arrive, with their position and index name."""
    source = spark.readStream.options(**csv_options()).schema(string_schema(columns))
    source = source.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    rows = with_position(source.option("pathGlobFilter", "*.csv").csv(folder), columns, F.lit(None))
    return rows.withColumn("index_name", index_name_from_path(F.col("source_path")))


def landing_workbooks(spark: SparkSession, folder: str, files_per_trigger: int = 100, numeric: str = "truncate") -> DataFrame:
    """Parsed rows of workbooks as they arrive."""
    source = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.xls*")
    source = source.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    rows = parse_workbooks(source.load(folder), numeric)
    return rows.withColumn("index_name", index_name_from_path(F.col("source_path")))


def _role_groups(catalog: DataFrame | None, names: list[str]) -> dict[tuple, list[str]]:
    """Index names grouped by their field roles; unknown indexes have none."""
    known = {}
    if catalog is not None:
        rows = catalog.where(F.col("index_name").isin(names)).select("index_name", "vector_fields", "exact_fields")
        known = {r.index_name: (tuple(r.vector_fields or ()), tuple(r.exact_fields or ())) for r in rows.collect()}
    groups: dict[tuple, list[str]] = {}
    for name in names:
        groups.setdefault(known.get(name, ((), ())), []).append(name)
    return groups


def _write_misplaced(batch: DataFrame, tables: Tables, is_workbook: bool) -> None:
    """Rows of files outside assets/<identity>/<index>/ become error rows without an index, once for each file."""
    error = F.lit("path gives no index name")
    lost = batch.where(F.col("index_name").isNull()).select(
        "index_name", "source_path", "row_no", (F.coalesce("error", error) if is_workbook else error).alias("error")
    )
    stored = tables.read(batch.sparkSession, "ingest_errors", lost.schema)
    if stored is not None:
        lost = lost.join(stored.where(F.col("index_name").isNull()).select("source_path").distinct(), "source_path", "left_anti")
    tables.append(lost.select("index_name", "source_path", "row_no", "error"), "ingest_errors")


def ingest_stream(
    rows: DataFrame,
    tables: Tables,
    checkpoint: str,
    embedder: Embedder | None = None,
    catalog: DataFrame | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Normalise, embed and append every batch of `landing_csv` or `landing_workbooks` rows. The source's
    checkpoint skips files already taken, and a batch that runs again adds nothing. Indexes with equal
    field roles share one plan. Rows whose path gives no index name go to ingest_errors. `catalog` defaults to the stored index_config table, read per batch."""
    is_workbook = "cells" in rows.columns

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            # bounded by the files of one trigger
            seen = batch.select("index_name", "source_path").distinct().collect()
            names = sorted({r.index_name for r in seen if r.index_name is not None})
            known = catalog if catalog is not None else tables.read(spark, "index_config")
            for (vectors, exacts), group in _role_groups(known, names).items():
                files = sorted({r.source_path for r in seen if r.index_name in group})
                part = batch.where(F.col("index_name").isin(group))
                errors = part if is_workbook else None
                if is_workbook:
                    part = widen_workbooks(part, workbook_columns(part))
                else:
                    part = part.drop("index_name")
                roles = {**dict.fromkeys(vectors, VECTOR), **dict.fromkeys(exacts, EXACT)}
                result = ingest(
                    part,
                    roles,
                    embedder,
                    index_name=index_name_from_path(F.col("source_path")),
                    file_errors=errors,
                    positioned=is_workbook,
                )
                tables.write_batch(result, group, files, [camel_case(h) for h in exacts])
            if any(r.index_name is None for r in seen):
                _write_misplaced(batch, tables, is_workbook)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
