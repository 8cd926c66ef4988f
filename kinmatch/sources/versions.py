"""Small tables that are replaced by key and read whole: versions as Parquet folders, published by a list of snapshots.

A change writes the new content to a folder of its own and then adds one row to the snapshot list; both are ordinary
Spark writes, so a version is there with all its rows or not at all, and readers of an older version keep theirs. Each
snapshot names its folder and schema, so that reading never merges schemas of files. Of writers that publish the same
version at once the one with the lowest token wins; the others see that and start again from the winner's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = "version bigint, token string, folder string, columns string, published_at timestamp"


class Conflict(RuntimeError):
    """Another writer published this version first."""


def stored_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """A table, or None while it has no files."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def widened(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of the schemas in order of appearance; one name has one type."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
            if known.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`; those that df lacks are null."""
    return df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class VersionedTable:
    root: str

    def snapshots(self, spark: SparkSession) -> DataFrame:
        """(version, token, folder, columns, published_at), one row per version: the winner's."""
        path = f"{self.root.rstrip('/')}/snapshots"
        rows = stored_or_none(lambda: spark.read.schema(SNAPSHOT).parquet(path))
        if rows is None:
            return spark.createDataFrame([], SNAPSHOT)
        names = [f.split()[0] for f in SNAPSHOT.split(", ")]
        return rows.groupBy("version").agg(F.min(F.struct(*names[1:])).alias("s")).select("version", "s.*")

    def latest(self, spark: SparkSession) -> Row | None:
        return self.snapshots(spark).orderBy(F.desc("version")).first()

    def _content(self, spark: SparkSession, snapshot: Row) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(snapshot["columns"]))).parquet(snapshot["folder"])

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the latest by default; None if there is none."""
        found = self.latest(spark) if version is None else self.snapshots(spark).where(F.col("version") == version).first()
        return None if found is None else self._content(spark, found)

    def publish(self, rows: DataFrame, after: int) -> int:
        """Make `rows` the version that follows `after`; raises Conflict if another writer did so first."""
        spark, token = rows.sparkSession, uuid.uuid4().hex
        folder = f"{self.root.rstrip('/')}/data/{after + 1:010d}-{token}"
        rows.write.parquet(folder)
        row = spark.createDataFrame([(after + 1, token, folder, rows.schema.json())], "version bigint, token string, folder string, columns string")
        row = row.withColumn("published_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root.rstrip('/')}/snapshots")
        if self.snapshots(spark).where(F.col("version") == after + 1).first()["token"] != token:
            raise Conflict(f"version {after + 1} of {self.root} was published by another writer")
        return after + 1

    def change(self, spark: SparkSession, edit: Callable[[DataFrame | None], DataFrame | None], attempts: int = 5) -> int:
        """Publish what `edit` makes of the latest content, again from the newer one after a conflict. Returns the version
        that holds the change; an edit that gives None changes nothing."""
        for attempt in range(attempts):
            found = self.latest(spark)
            now, version = (None, 0) if found is None else (self._content(spark, found), found["version"])
            made = edit(now)
            if made is None:
                return version
            try:
                return self.publish(made, version)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def replace(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Rows take the place of those with equal keys and are added otherwise. Keys are unique in `rows`; columns that one side
        lacks are null there."""
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"rows repeat a key of {list(keys)}")

        def edit(now: DataFrame | None) -> DataFrame:
            if now is None:
                return rows
            schema = widened([now.schema, rows.schema])
            gone = rows.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
            return conformed(now.join(gone, same, "left_anti"), schema).unionByName(conformed(rows, schema))

        return self.change(rows.sparkSession, edit)

