"""Token ids as flat binary files.

Documents are range-sorted by id and encoded; every task streams its ids to one shard:

    <name>.ids   unsigned little-endian integers, the narrowest of 16 and 32 bits that holds the vocabulary
    <name>.off   n + 1 unsigned 64-bit offsets of the shard's documents, counted in ids
    <name>.doc   n signed 64-bit document ids; the smallest integer stands for a null id

and returns one manifest row. The manifest (Parquet, one row per shard) gets each shard's base, the number of ids in all
shards before it, as a prefix sum; base + offset is a document's place in the whole sequence. Readers take one task per
shard and memory-map its files where they are local, else read them through the same file system.

A shard's name is new for every attempt of a task, and only names that the manifest lists count: an attempt that was lost
or repeated leaves files that nobody reads. Folders must be shared by all executors.

Edge cases: a null or empty text is a document that holds only the end id. Null ids come first, equal ids are ordered by
text. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm.flat import slices
from kinmatch.llm.tokens import chunk_encoder, crc32, tokenizer

MANIFEST = "shard int, name string, n_docs bigint, n_ids bigint"
NULL_ID = np.iinfo(np.int64).min


def id_type(path: str) -> str:
    """Type of one id: the narrowest that holds the vocabulary."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _writer(folder: str, path: str, end_id: int, kind: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        end = np.array([end_id], kind).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        name, n_docs, n_ids, out = f"shard-{uuid.uuid4().hex}", 0, 0, None
        for batch in slices(batches, "text"):
            if out is None:
                out = [store.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "off", "doc")]
                out[1].write(np.zeros(1, "<u8").tobytes())
            found = encoder.encode(batch.column("text").fill_null("").to_pylist())
            out[0].write(b"".join([x for ids in found for x in (ids.astype(kind).tobytes(), end)]))
            ends = n_ids + np.cumsum([len(ids) + 1 for ids in found])
            out[1].write(ends.astype("<u8").tobytes())
            out[2].write(np.asarray(batch.column("doc_id").fill_null(NULL_ID)).astype("<i8").tobytes())
            n_docs, n_ids = n_docs + batch.num_rows, int(ends[-1])
        if out is not None:
            for x in out:
                x.close()
            row = [[TaskContext.get().partitionId()], [name], [n_docs], [n_ids]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["shard", "name", "n_docs", "n_ids"])

    return write


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to `folder` in ascending order of ids, each with `end_id` appended; returns the manifest with bases."""
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/data", recursive=True)
    ordered = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_writer(f"{folder}/data", path, end_id, id_type(path)), MANIFEST)
    rows.write.parquet(f"{folder}/shards")
    shards = spark.read.schema(rows.schema).parquet(f"{folder}/shards")
    # One row per shard, so the window's single task stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _opened(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.readall(), kind)


def read_token_files(spark: SparkSession, folder: str, path: str, ids: bool = True, rows: int = 1000) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the ids of each document."""
    kind = id_type(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            for shard in batch.to_pylist():
                flat, off, doc = (_opened(store, f"{root}/{shard['name']}.{x}", k) for x, k in (("ids", kind), ("off", "<u8"), ("doc", "<i8")))
                for i in range(0, len(doc), rows):
                    cuts = off[i : i + rows + 1].astype(np.int64)
                    names = np.asarray(doc[i : i + rows])
                    part = [np.asarray(flat[a:b]).astype("<u4") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    out = {
                        "doc_id": pa.array(names, mask=names == NULL_ID),
                        "start": pa.array(cuts[:-1] + shard["base"]),
                        "n_tokens": pa.array(cuts[1:] - cuts[:-1]),
                        "ids_crc32": pa.array([crc32(x) for x in part], pa.int64()),
                    }
                    if ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in part], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    manifest = spark.read.schema(f"{MANIFEST}, base bigint").parquet(f"{folder}/manifest")
    shape = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return manifest.repartition(spark.sparkContext.defaultParallelism, "shard").mapInArrow(read, shape)
