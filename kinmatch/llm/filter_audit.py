"""Filter interaction audit by incremental retraction streaming.

Five filters (`FILTERS`) drop documents; what each order of them removes at each step follows from how many documents of a
part (a language) fail each set of filters. Four filters see a document alone. The fifth, E, fails a document whose text is
that of a document with a smaller id, so a document that arrives late may change the verdict on one that was counted.

1. The files are read as a stream, all that are there, in about BATCHES micro-batches. Each document becomes a narrow row:
   a digest of the text (SHA-256), its id, its part and labels, and the mask of the filters A to D that it fails.
2. Before the shuffle every task keeps, for each text, the rows of the smallest id; the others fail E for certain and are
   counted at once. So a text that a third of all rows share sends a few rows.
3. Keyed state holds the smallest id of every text seen and the counts (part, mask, labels) of the rows under it. The key of the
   state is a bucket of digests, one for about BUCKET documents, so that Python is called once for a bucket. A row with a
   larger id is counted with E. When a smaller id arrives, the rows of the earlier one are retracted: their counts are
   taken back and given again with E.
4. Every micro-batch writes the changes to the part counters, under its number, so that a batch that is run again after a
   failure replaces its own. The counters are their sum, and the report is made from them.

State lives in the session's state store (some 60 bytes for each different text; with RocksDB as
spark.sql.streaming.stateStore.providerClass it may exceed memory) and, like the counters, in the shared scratch folder; nothing is
collected. Counters have one row for each part, mask and labels, however many documents there are.

Edge cases: null and empty texts are one text, of no words. Null parts count as the empty string. Rows under one id with one text
share their verdict on E, and each counts. A null id is smaller than none, and none is smaller than it: such rows never
fail E. Labels of repeated ids: quality and toxic hold if they hold in any row; without a row they do not. Very long texts
count whole. Empty tables give no parts and so no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kinmatch.session import scratch_folder

FILTERS = "ABCDE"
BATCHES = 4
BUCKET = 1000
#: A partition of the state holds about so many documents; each has files of its own in every micro-batch.
PARTITION = 50_000
#: Rows that a task holds to keep the smallest ids by text.
HELD = 200_000

_E = 1 << FILTERS.index("E")
_SPACE = "[ \\t-\\r]+"


def failed_alone(text: str = "text") -> Column:
    """Mask of the filters A to D that a text fails: bit 0 is A."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(F.split(whole, _SPACE), lambda w: w != "")
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n = F.size(found)
    tests = [n < 100, 100 * F.size(F.array_distinct(found)) < 80 * n, 100 * capitals > 10 * F.length(whole), whole.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for bit, test in enumerate(tests):
        mask = mask + F.when(test, 1 << bit).otherwise(0)
    return mask.cast("int")


# ---- changes to counters -------------------------------------------------------------------------------

_CANDIDATES = ["bucket", "digest", "doc_id", "part", "mask", "n"]


def _settle(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of the smallest id of each text, summed by part and mask, and the others."""
    least = rows.groupby("digest", sort=False)["doc_id"].transform("min")
    first = rows["doc_id"] == least
    return rows[first].groupby(["bucket", "digest", "doc_id", "part", "mask"], sort=False, as_index=False)["n"].sum(), rows[~first]


def _smallest(buckets: int, held: int = HELD):
    """Rows (bucket, digest, doc_id, part, mask, n): for each text those of a task's smallest id, and counts of the others.

    A row of counts has no digest; its bucket only deals it out. The mask holds the labels too (bits 5 and 6)."""

    def settle(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(tables).to_pandas()
        # Null ids are nobody's smaller id: counted as they are.
        missing = rows["doc_id"].isna()
        nulls, rows = rows[missing], rows[~missing].astype({"doc_id": "int64"})
        rows["bucket"] = np.array([int.from_bytes(d[:4], "big") for d in rows["digest"]], np.int64) % buckets
        rows["n"] = 1
        kept, others = _settle(rows)
        counts = pd.concat([nulls[["part", "mask"]], others[["part", "mask"]].assign(mask=others["mask"] | _E)])
        counts = counts.groupby(["part", "mask"], sort=False, as_index=False).size().rename(columns={"size": "n"})
        start = int.from_bytes(rows["digest"].iloc[0][4:8], "big") if len(rows) else 0
        counts["bucket"] = (start + np.arange(len(counts))) % buckets
        for part in (kept, counts.assign(digest=None, doc_id=None)):
            yield pa.RecordBatch.from_pandas(part[_CANDIDATES], schema=_SHAPE, preserve_index=False)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [], 0
        for batch in batches:
            tables.append(batch)
            n += batch.num_rows
            if n >= held:
                yield from settle(tables)
                tables, n = [], 0
        if n:
            yield from settle(tables)

    return smallest


_SHAPE = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_STATE = "rows binary"
_STATE_SHAPE = pa.schema(list(_SHAPE)[1:])


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows[_STATE_SHAPE.names], schema=_STATE_SHAPE, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE_SHAPE) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _update(key, batches, state) -> Iterator[pd.DataFrame]:
    """Changes (part, mask, n) that new rows of a bucket bring; the state is the rows of the smallest ids, by text."""
    new = pd.concat(list(batches), ignore_index=True)
    counted = new["digest"].isna()
    changes = [new.loc[counted, ["part", "mask", "n"]]]
    new = new[~counted].astype({"doc_id": "int64"})
    if len(new):
        old = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else new.iloc[:0]
        old = old.assign(bucket=key[0], known=True)
        everything = pd.concat([old, new.assign(known=False)], ignore_index=True)
        first = everything["doc_id"] == everything.groupby("digest", sort=False)["doc_id"].transform("min")
        known = everything["known"].astype(bool)
        late = everything[~first]
        # What is new is counted; what was counted as a smallest id and no longer is one, is taken back and given with E.
        changes += [everything.loc[first & ~known, ["part", "mask", "n"]], late[["part", "mask", "n"]].assign(mask=late["mask"] | _E)]
        back = everything[~first & known]
        changes.append(back[["part", "mask", "n"]].assign(n=-back["n"]))
        kept = everything[first].groupby(["digest", "doc_id", "part", "mask"], sort=False, as_index=False)["n"].sum()
        state.update((_packed(kept),))
    changes = pd.concat(changes, ignore_index=True)
    changes = changes.groupby(["part", "mask"], sort=False, as_index=False)["n"].sum()
    yield changes[changes["n"] != 0].astype({"mask": "int32", "n": "int64"})


def _streamable(path: str, files: list[str]) -> str:
    """The path itself, or a pattern for it if it is a file: streams are read from folders or patterns."""
    path = path.rstrip("/")
    name = path.rsplit("/", 1)[-1]
    single = len(files) == 1 and files[0].split("/")[-1] == name and files[0].split("/")[-2] != name
    return f"{path[:-1]}[{path[-1]}]" if single else path


# ---- operator ------------------------------------------------------------------------------------------


def part_counters(spark, path: str, labels: DataFrame, batches: int = BATCHES, held: int = HELD, bucket: int = BUCKET) -> DataFrame:
    """(part, failed, quality, toxic, n): documents of a part that fail a set of filters, from the files below `path`."""
    folder = scratch_folder(spark, "filter-audit")
    given = spark.read.parquet(path)
    files = given.inputFiles()
    n = given.count()
    buckets = max(1, n // bucket)
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("int").alias(c) for c in ("quality", "toxic")]
    labels.where("doc_id IS NOT NULL").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(*flags).write.parquet(f"{folder}/labels")
    labels = spark.read.parquet(f"{folder}/labels")

    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(_streamable(path, files))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    narrow = stream.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), digest, failed_alone().alias("failed"))
    marked = narrow.join(labels, "doc_id", "left")
    mask = F.col("failed") + F.when(F.col("quality") == 1, 32).otherwise(0) + F.when(F.col("toxic") == 1, 64).otherwise(0)
    least = marked.select("digest", "doc_id", "part", mask.alias("mask")).mapInArrow(
        _smallest(buckets, held), "bucket bigint, digest binary, doc_id bigint, part string, mask int, n bigint"
    )
    changes = least.groupBy("bucket").applyInPandasWithState(_update, "part string, mask int, n bigint", _STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    partitions = "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set(partitions, min(int(before), 1 + n // PARTITION))
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").start()
        query.awaitTermination()
    finally:
        spark.conf.set(partitions, before)
    shape = "part string, mask int, n bigint"
    written = query.lastProgress is not None and query.lastProgress["batchId"] >= 0 and files
    found = spark.read.schema(shape).parquet(f"{folder}/changes/*") if written else spark.createDataFrame([], shape)
    bits = lambda b: F.col("mask").bitwiseAND(F.lit(b))
    summed = found.groupBy("part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    return summed.select("part", bits(31).alias("failed"), (bits(32) > 0).alias("quality"), (bits(64) > 0).alias("toxic"), "n")


def audit(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the filter of that step removes."""
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    each = counters.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit, earlier = F.lit(0), F.lit(0)
    for k, letter in enumerate(FILTERS):
        bit = bit + F.when(F.col("letter") == letter, 1 << k).otherwise(0)
        earlier = earlier + F.when(F.instr("filter_order", letter) <= F.col("at"), 1 << k).otherwise(0)
    each = each.withColumn("step", (F.col("at") + 1).cast("int")).withColumn("bit", bit).withColumn("earlier", earlier)
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) > 0, F.col("failed").bitwiseAND(F.col("earlier")) > 0
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    found = each.groupBy("part", "filter_order", "step", "bit").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & F.col("quality")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    shares = each.where(fails & ~gone).groupBy("part", "bit").agg(F.sum("n").alias("shapley"))
    found = found.join(shares, ["part", "bit"], "left").withColumn("shapley", F.coalesce("shapley", F.lit(0)))
    return found.drop("bit")


def filter_audit(spark, path: str, labels: DataFrame, **options) -> DataFrame:
    """The audit of the documents in the Parquet files at `path` (doc_id, text, lang), with labels (doc_id, quality, toxic)."""
    return audit(part_counters(spark, path, labels, **options))
