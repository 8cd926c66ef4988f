"""From raw rows to item rows, work-queue rows and error rows."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.functions.cells import bad_number, cell_text
from kinmatch.functions.display import row_id
from kinmatch.functions.embed import Embedder, hashed_embedder
from kinmatch.functions.text import NAME_FIELDS, camel_case, embedding_name, is_name_field
from kinmatch.plans.spec import VECTOR
from kinmatch.sources.files import POSITION

log = logging.getLogger(__name__)

SYSTEM = ("index_name", "item_id", "created_at", "updated_at")


@dataclass
class IngestResult:
    items: DataFrame  # system columns, text columns, vectors
    queue: DataFrame  # same rows without vectors, with time stamps
    errors: DataFrame  # (index_name, source_path, row_no, error)
    counts: DataFrame  # (source_path, successful, total)


def camel_columns(columns: Sequence[str]) -> dict[str, str]:
    """camelCase name -> raw column. Of several columns with one name the last is taken."""
    out: dict[str, str] = {}
    for c in columns:
        name = camel_case(c)
        if name in out:
            log.warning("columns %r and %r are both called %s; the last is kept", out[name], c, name)
            del out[name]
        out[name] = c
    return out


def rename_columns(df: DataFrame) -> DataFrame:
    """All columns under their camelCase names."""
    return df.select(*[F.col(f"`{raw}`").alias(name) for name, raw in camel_columns(df.columns).items()])


def normalised(df: DataFrame, keep: Sequence[str] = (), name_fields: Sequence[str] = NAME_FIELDS, numeric: str = "truncate") -> DataFrame:
    """Text columns under camelCase names, plus the columns in `keep` and `error` for bad cells."""
    types = {f.name: f.dataType for f in df.schema.fields}
    named = camel_columns([c for c in df.columns if c not in keep])
    texts = [
        cell_text(F.col(f"`{raw}`"), types[raw], is_name_field(raw, name_fields), numeric).alias(name)
        for name, raw in named.items()
    ]
    bad = [
        F.when(bad_number(F.col(f"`{raw}`"), types[raw]), F.lit(f"{raw}: number has no integer form"))
        for raw in named.values()
    ]
    error = F.coalesce(*bad) if bad else F.lit(None).cast("string")
    return df.select(*keep, *texts, error.alias("error"))


def with_item_ids(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Stable ids. Rows with a position use path and row number. Others (CSV) use path, content and the
    running number among equal rows of the file. Equal rows are numbered within each file split, which
    bounds every window, and splits are then offset by the counts of the earlier ones."""
    by_row = row_id(F.col("source_path"), F.lit("row"), F.col("row_no"))
    df = df.withColumn("_content", F.sha2(F.to_json(F.array(*texts)) if texts else F.lit(""), 256))
    numbered = df.where(F.col("row_no").isNotNull()).withColumn("item_id", by_row)
    loose = df.where(F.col("row_no").isNull())
    per_split = ["source_path", "_content", "block_start"]
    order = W.partitionBy(*per_split).orderBy("_content")
    loose = loose.withColumn("_nth", F.row_number().over(order))
    counts = df.where(F.col("row_no").isNull()).groupBy(*per_split).count()
    earlier = W.partitionBy("source_path", "_content").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("count").over(earlier)).where("_before > 0").drop("count")
    loose = loose.join(offsets, per_split, "left")
    nth = F.col("_nth") + F.coalesce("_before", F.lit(0))
    loose = loose.withColumn("item_id", row_id(F.col("source_path"), F.col("_content"), nth)).drop("_nth", "_before")
    return numbered.unionByName(loose.select(*numbered.columns)).drop("_content")


def ingest(
    raw: DataFrame,
    roles: Mapping[str, str],
    embedder: Embedder | None = None,
    *,
    index_name: str | Column,
    file_errors: DataFrame | None = None,
    name_fields: Sequence[str] = NAME_FIELDS,
    numeric: str = "truncate",
    now: Column | None = None,
    positioned: bool | None = None,
) -> IngestResult:
    """Normalise and embed raw rows from `sources.files`. `roles` maps raw columns to VECTOR, EXACT or
    IGNORE; unlisted columns are stored as text. `file_errors` are parsed workbook rows with an error.
    `positioned=True` says every row has a row number, which spares the numbering of equal rows."""
    missing = [c for c in POSITION if c not in raw.columns]
    if missing:
        raise ValueError(f"raw rows need the columns {POSITION}; missing: {missing}")
    name = F.lit(index_name) if isinstance(index_name, str) else index_name
    clean = normalised(raw, POSITION, name_fields, numeric)
    texts = [c for c in clean.columns if c not in (*POSITION, "error")]
    clean = clean.withColumn("index_name", name)
    stamp = (now if now is not None else F.current_timestamp()).cast("timestamp")

    good = clean.where(F.col("error").isNull()).drop("error")
    if positioned:
        good = good.withColumn("item_id", row_id(F.col("source_path"), F.lit("row"), F.col("row_no")))
    else:
        good = with_item_ids(good, texts)
    system = ["index_name", "item_id", "source_path", "row_no"]
    queue = good.select(*system, stamp.alias("created_at"), stamp.alias("updated_at"), *texts)

    items = good.select(*system, *texts)
    embed = embedder or hashed_embedder()
    for raw_name, role in roles.items():
        if role == VECTOR and camel_case(raw_name) in texts:
            field = camel_case(raw_name)
            items = embed(items, field, embedding_name(field))
            vector = F.when(F.col(field) != "", F.col(embedding_name(field)))
            items = items.withColumn(embedding_name(field), vector)

    errors = clean.where(F.col("error").isNotNull()).select("index_name", "source_path", "row_no", "error")
    if file_errors is not None:
        bad = file_errors.where(F.col("error").isNotNull())
        errors = errors.unionByName(bad.select(name.alias("index_name"), "source_path", "row_no", "error"))
    return IngestResult(items, queue, errors, ingest_counts(clean, file_errors))


def ingest_counts(rows: DataFrame, file_errors: DataFrame | None = None) -> DataFrame:
    """(source_path, successful, total) from rows with an `error` column; unreadable files count 0 of 0."""
    seen = rows.select("source_path", F.lit(1).alias("n"), F.col("error").isNull().cast("int").alias("ok"))
    if file_errors is not None:
        bad = file_errors.where(F.col("error").isNotNull())
        n = F.when(F.col("row_no") == 0, F.lit(0)).otherwise(F.lit(1))
        seen = seen.unionByName(bad.select("source_path", n.alias("n"), F.lit(0).alias("ok")))
    return seen.groupBy("source_path").agg(F.sum("ok").alias("successful"), F.sum("n").alias("total"))


def file_status(items: DataFrame, errors: DataFrame) -> DataFrame:
    """(source_path, status, successful, failed) per file: failed when nothing of it was stored."""
    rows = items.select("source_path", F.lit(1).alias("ok")).unionByName(errors.select("source_path", F.lit(0).alias("ok")))
    per_file = rows.groupBy("source_path").agg(
        F.sum("ok").cast("bigint").alias("successful"), F.sum(1 - F.col("ok")).cast("bigint").alias("failed")
    )
    status = F.when(F.col("successful") > 0, F.lit("success")).otherwise(F.lit("failed"))
    return per_file.select("source_path", status.alias("status"), "successful", "failed")


def drop_vectors(df: DataFrame) -> DataFrame:
    """Without embedding columns and engine columns."""
    return df.select(*[c for c in df.columns if not c.endswith("Embedding") and c not in ("_index", "_id")])


def drop_system(df: DataFrame) -> DataFrame:
    """Item columns only, as they are shown."""
    return df.drop(*SYSTEM, "source_path", "row_no")
