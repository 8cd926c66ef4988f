"""Texts kept in the shared scratch folder, one folder for each task that wrote them.

Later steps bring their small rows to the task that reads a folder, so that texts are never shuffled. A row's `uid` is drawn
once, when it is written: the task's number, shifted by 33 bits, and the row's number in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parts(rows: DataFrame, folder: str) -> DataFrame:
    """Stores rows with uid and part; returns the stored table."""
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("uid", 33).cast("int")).sortWithinPartitions("part", "uid")
    rows.write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def to_parts(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with a uid, to the task that reads their folder, sorted by part, uid and `order`."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.shiftright("uid", 33).cast("int"))
    return rows.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part", "uid", *order)


def read_part(folder: str, part: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The stored rows of one task, in order of uid."""
    store, root = fs.FileSystem.from_uri(folder)
    found = ds.dataset(f"{root}/part={part}", filesystem=store, format="parquet")
    yield from found.to_batches(columns=columns, batch_size=1000, batch_readahead=1, fragment_readahead=1, use_threads=False)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by `part`, a table for each."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and parts[a] != last:
                yield last, pa.concat_tables(held)
                held = []
            last = int(parts[a])
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield last, pa.concat_tables(held)
