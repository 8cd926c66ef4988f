"""Item, queue, error and catalog tables as Parquet folders partitioned by index."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.sources.ingest import IngestResult
from kinmatch.sources.versions import stored_or_none, widened


@dataclass(frozen=True)
class Tables:
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _schemas(self, spark: SparkSession, name: str) -> list[T.StructType]:
        """The different schemas that were appended to a table, oldest first."""
        rows = stored_or_none(lambda: spark.read.schema("columns string, added_at timestamp").parquet(self.path(f"schemas_of_{name}")))
        if rows is None:
            return []
        found = rows.groupBy("columns").agg(F.min("added_at").alias("at")).orderBy("at", "columns").collect()
        return [T.StructType.fromJson(json.loads(r["columns"])) for r in found]

    def read(self, spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """The table, or None while it has no files. Its columns are those of all appends, kept beside the table: no file
        is opened to learn them."""
        known = self._schemas(spark, name)
        if schema is None and known:
            schema = widened(known)
        reader = spark.read.schema(schema) if schema else spark.read
        return stored_or_none(lambda: reader.parquet(self.path(name)))

    def append(self, rows: DataFrame, name: str) -> None:
        """Rows are rebalanced by index: small ones share a file, a large one is split over tasks. Sorting by
        source file gives narrow row-group statistics for the look-up in `append_new`."""
        spark, known = rows.sparkSession, self._schemas(rows.sparkSession, name)
        merged = widened([*known, rows.schema])
        if not known or merged != widened(known):
            added = spark.createDataFrame([(rows.schema.json(),)], "columns string").withColumn("added_at", F.current_timestamp())
            added.coalesce(1).write.mode("append").parquet(self.path(f"schemas_of_{name}"))
        rows = rows.hint("rebalance", "index_name").sortWithinPartitions("index_name", "source_path")
        rows.write.mode("append").partitionBy("index_name").parquet(self.path(name))

    def write_bucketed(self, rows: DataFrame, name: str, buckets: int, key: str = "item_id") -> DataFrame:
        """The rows as a table of the session's catalog below this root, hashed and sorted by `key` into buckets: joins of
        such tables by key read matching buckets and need no shuffle. Replaces a table of that name."""
        spark, table = rows.sparkSession, f"{name}_by_{key}"
        writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet")
        writer.bucketBy(buckets, key).sortBy(key).option("path", self.path(table)).saveAsTable(table)
        return spark.table(table)

    def append_new(self, rows: DataFrame, name: str, keys: list[str], indexes: list[str], files: list[str]) -> None:
        """Append the rows that are not stored yet. Stored rows are looked up only in the partitions and,
        by the row-group statistics of `source_path`, the files that the batch can repeat."""
        schema = rows.select(*dict.fromkeys(["index_name", "source_path", *keys])).schema
        stored = self.read(rows.sparkSession, name, schema)
        if stored is not None:
            stored = stored.where(F.col("index_name").isin(indexes) & F.col("source_path").isin(files))
            rows = rows.join(stored.select(*keys), keys, "left_anti")
        self.append(rows, name)

    def write_batch(self, result: IngestResult, indexes: list[str], files: list[str], exact_fields: Sequence[str] = ()) -> None:
        """Items first, then queue, then errors; each is checked on its own, so a batch that failed half
        way is completed when it runs again. Last the value counts of `exact_fields` in the batch's files."""
        self.append_new(result.items, "items", ["index_name", "item_id"], indexes, files)
        self.append_new(result.queue, "queue", ["index_name", "item_id"], indexes, files)
        self.append_new(result.errors, "ingest_errors", ["index_name", "source_path", "row_no", "error"], indexes, files)
        fields = [f for f in dict.fromkeys(exact_fields) if f in result.items.columns]
        self.append_counts(result.items.sparkSession, fields, indexes, files)

    def append_counts(self, spark: SparkSession, fields: Sequence[str], indexes: list[str], files: list[str]) -> None:
        """Value counts of the stored items of some files, with the number of items under the field ''. A file's counts are always
        those of all its stored items and carry the time they were taken: the latest count, so that a file that is counted again
        after a failure, or after more of its rows came, is not counted twice."""
        schema = f"index_name string, source_path string{''.join(f', `{f}` string' for f in fields)}"
        items = self.read(spark, "items", T.StructType.fromDDL(schema))
        items = items.where(F.col("index_name").isin(indexes) & F.col("source_path").isin(files))
        cells = [F.struct(F.lit("").alias("field"), F.lit("").alias("value"))]
        cells += [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields]
        rows = items.select("index_name", "source_path", F.explode(F.array(*cells)).alias("c")).where("c.field = '' OR c.value <> ''")
        counts = rows.groupBy("index_name", "source_path", "c.field", "c.value").agg(F.count("*").alias("n"))
        self.append(counts.withColumn("counted_at", F.unix_micros(F.current_timestamp())), "term_counts")

    def term_counts(self, spark: SparkSession, index_name: str) -> DataFrame | None:
        """(field, value, n) over all files of an index, as `match` takes it: no item is read. None if nothing was counted."""
        rows = self.read(spark, "term_counts")
        if rows is None:
            return None
        rows = rows.where(F.col("index_name") == index_name)
        latest = rows.groupBy("source_path").agg(F.max("counted_at").alias("counted_at"))
        return rows.join(latest, ["source_path", "counted_at"]).groupBy("field", "value").agg(F.sum("n").alias("n"))


def queue_page(queue: DataFrame, index_name: str, limit: int = 10) -> DataFrame:
    """First rows of one index in key order."""
    return queue.where(F.col("index_name") == index_name).orderBy("item_id").limit(limit)
