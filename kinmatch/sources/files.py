"""Reading raw item files: workbooks, CSV and Parquet, with the path and position of every row.

Every reader gives the file's own columns plus `source_path`, `row_no` (null for CSV, where Spark has no
row position) and `block_start`, the offset of the file split a row was read from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.sources.workbook import read_first_sheet

# Media types of spreadsheet files.
WORKBOOK_TYPES = (
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
)
POSITION = ("source_path", "row_no", "block_start")


def is_workbook(file_name: Column, media_type: Column | None = None) -> Column:
    """Whether a file is a spreadsheet, by its extension or, if given, its media type."""
    by_name = file_name.rlike(r"\.xlsx?$")
    if media_type is None:
        return by_name
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(media_type.isin(*WORKBOOK_TYPES), F.lit(False))


def index_name_from_path(path: Column) -> Column:
    """The folder below assets/<identity>/ of an upload path, after URL decoding."""
    decoded = F.coalesce(F.try_url_decode(path), path)
    parts = F.split(F.regexp_extract(decoded, r"(?:^|/)(assets/.*)$", 1), "/")
    return F.try_element_at(parts, F.lit(3))


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file or folder."""
    return spark.read.option("header", True).csv(path).columns


def with_position(df: DataFrame, columns: Sequence[str], row_no: Column) -> DataFrame:
    return df.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns],
        F.col("_metadata.file_path").alias("source_path"),
        row_no.cast("bigint").alias("row_no"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def csv_options(multi_line: bool = False) -> dict[str, str]:
    """A file whose header differs from the schema fails instead of being read by position."""
    return {"header": "true", "enforceSchema": "false", "multiLine": str(multi_line).lower(), "escape": '"'}


def read_csv(spark: SparkSession, paths: str | list[str], columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV files with the given header. Blank cells are ''. Set `multi_line` for line breaks inside cells;
    such files cannot be split."""
    df = spark.read.options(**csv_options(multi_line)).schema(string_schema(columns)).csv(paths)
    return with_position(df, columns, F.lit(None))


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed columns; the row position comes from the file format."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.row_index").alias("row_no"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


WORKBOOK_ROWS = "source_path string, row_no bigint, cells map<string,string>, error string"


def parse_workbooks(files: DataFrame, numeric: str = "truncate") -> DataFrame:
    """(source_path, row_no, cells, error) from a binaryFile table (path, content). One row per sheet row;
    a file that cannot be read gives one row with its error. Row 0 with null cells marks a read file, so
    that files without data rows are still reported."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_path", "row_no", "cells", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = [(path, 0, None, None)]
                try:
                    for n, (cells, error) in enumerate(read_first_sheet(content, numeric), start=1):
                        rows.append((path, n, cells, error))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as e:
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, WORKBOOK_ROWS)


def read_workbooks(
    spark: SparkSession, paths: str | list[str], numeric: str = "truncate"
) -> DataFrame:
    """Parsed rows of all workbooks at the paths, one task per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(paths)
    return parse_workbooks(files, numeric)


def workbook_columns(parsed: DataFrame) -> list[str]:
    """All headers that occur, sorted. Bounded by the width of the sheets."""
    names = parsed.select(F.explode(F.map_keys("cells")).alias("c")).distinct()
    return sorted(r.c for r in names.collect())


def widen_workbooks(parsed: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Parsed rows with one text column per header; cells of columns a file lacks are ''."""
    return parsed.where(F.col("cells").isNotNull()).select(
        *[F.coalesce(F.col("cells")[c], F.lit("")).alias(c) for c in columns],
        "source_path",
        "row_no",
        F.lit(0).cast("bigint").alias("block_start"),
    )


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First rows of a file in order of position; the header is `df.columns`."""
    place = [c for c in POSITION if c in df.columns]
    return (df.orderBy(*place) if place else df).limit(rows).drop(*POSITION)
